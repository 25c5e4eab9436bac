"""Licenses that contain each other, and parts of licenses."""

from __future__ import annotations

import random

import pytest

from tidemark.llm import licenses

TEMPLATES = [licenses.Template(n, t, licenses.LEAST) for n, t in licenses.TEMPLATES.items()]


def names(text):
    return [f["license"] for f in licenses.scan(text.encode(), TEMPLATES)]


def test_a_license_is_not_taken_for_one_that_it_contains():
    two, three = licenses.TEMPLATES["bsd-2-clause"], licenses.TEMPLATES["bsd-3-clause"]
    assert names(two) == ["bsd-2-clause"] and names(three) == ["bsd-3-clause"]
    assert names(f"{three} and {two}") == ["bsd-3-clause", "bsd-2-clause"]


def test_the_first_part_of_a_license_is_no_license():
    assert names(licenses.TEMPLATES["bsd-2-clause"].split("THIS SOFTWARE")[0]) == []
    assert names(licenses.TEMPLATES["unlicense"].split("In jurisdictions")[0]) == []


def test_neighbours_both_stay():
    for a in ("mit", "isc", "mpl-2.0-header"):
        for b in ("unlicense", "gpl-3.0-header", "mit-notice"):
            assert sorted(names(f"{licenses.TEMPLATES[a]} {licenses.TEMPLATES[b]}")) == sorted([a, b])


def longest_common(a, b):
    """Words of the longest common subsequence, plainly."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b):
            before, row[k + 1] = row[k + 1], before + 1 if x == y else max(row[k + 1], row[k])
    return row[-1]


@pytest.mark.parametrize("name", ["mit", "isc", "bsd-2-clause", "unlicense", "gpl-3.0-header", "mit-notice", "cc-by-4.0-notice"])
def test_coverage_against_the_longest_common_subsequence(name):
    """Words left out and put in: what is aligned is common, nearly all that is, and its ends are the text's."""
    rng = random.Random(name)
    template = licenses.Template(name, licenses.TEMPLATES[name], 0.8)
    for put_in, left_out in ((0, 0), (2, 0), (1, 0.08), (5, 0), (0, 0.15), (3, 0.05)):
        # A text ends where the template's telling words are further apart than twice its length.
        put_in = min(put_in, len(template.words) // 4)
        words = [w for w in template.words if rng.random() >= left_out]
        text = [x for w in words for x in (w, *(f"extra{rng.randint(0, 999)}".encode() for _ in range(put_in)))]
        around = [f"word{k}".encode() for k in range(500)]
        common = longest_common(text, template.words) / len(template.words)
        found = list(template.find([*around, *text, *around], set(around) | set(text)))
        if common >= 0.85:
            assert len(found) == 1
            start, stop, coverage, aligned = found[0]
            assert common - 0.05 <= coverage <= common and start >= 500 and stop <= 500 + len(text)
            assert len(aligned) == round(coverage * len(template.words))
            if put_in == 2:
                assert (start, stop, coverage) == (500, 500 + len(text) - put_in, 1.0)
        elif common < 0.8:
            assert not found


def test_texts_in_a_row_are_found_apart():
    body = licenses.TEMPLATES["mit"]
    found = licenses.scan(f"{body}\n{body}\n{body}".encode(), [licenses.Template("mit", body, 0.8)])
    assert [f["license"] for f in found] == ["mit"] * 3 and [f["start"] for f in found] == [0, len(body) + 1, 2 * len(body) + 2] and all(f["coverage"] == 1 for f in found)


def test_ties_go_to_the_first_name():
    templates = [licenses.Template(n, licenses.TEMPLATES["isc"], 0.8) for n in ("b", "a")]
    assert [f["license"] for f in licenses.scan(licenses.TEMPLATES["isc"].encode(), templates)] == ["a"]
