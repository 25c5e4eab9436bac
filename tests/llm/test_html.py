"""Wrappers of hosts whose pages differ in layout."""

from __future__ import annotations

import random
import re

import pytest

from tidemark.llm import html


def wrapper_of(pages):
    """By way of partial wrappers of two shapes each."""
    return html.infer(pages, fan_in=2)


def part(symbol, *parts, many=False):
    return [symbol, many, False, list(parts)]


def test_parts_meet_only_within_equal_containers():
    """A few pages of the host have a second heading; their texts aren't taken for the footer's."""
    plain = "<body><article><h1>Title {n}</h1><p>Text {n}</p></article><footer>Imprint</footer></body>"
    longer = "<body><article><h1>Title {n}</h1><p>Text {n}</p><h2>Part {n}</h2><p>More {n}</p></article><footer>Imprint</footer></body>"
    pages = [(longer if n % 5 == 4 else plain).format(n=n) for n in range(20)]
    wrapper = wrapper_of(pages)
    for n, p in enumerate(pages):
        assert html.extract(p, wrapper) == f"Title {n}\nText {n}" + (f"\nPart {n}\nMore {n}" if n % 5 == 4 else "")


def test_alignment_is_over_the_whole_length():
    """Far more than a look-ahead could span is new on one side; and of all alignments it is one of the longest."""
    common, new = [f"c{k}" for k in range(5)], [f"n{k}" for k in range(600)]
    a, b = ([part(x) for x in s] for s in (["a", *common, "z"], ["a", *new[:300], *common, *new[300:], "c4", "y"]))
    met = [(a[i][0], b[j][0]) for i, n, j, m in html.align(a, b) if n and m]
    assert met == [(x, x) for x in ["a", *common]]


ENTRY = "<h1>A title</h1><p>The first words of an entry</p><p>and some more of them</p>"
MENU = "<nav>menu</nav>"
AROUND = [
    "<body class='single no-sidebar'><article>{}</article></body>",
    "<body class='no-sidebar cookie-consent header-fixed'>{menu}<div id=page><article>{}</article></div><div class=sidebar>aside</div></body>",
    "<body><form id='aspnetForm'>{menu}<div id=page><article>{}</article></div><div class=related><div><article>card</article></div></div></form></body>",
    "<body><article class='post comment-open'>{}<div class=comments>a reply</div></article><article class=comment>a comment</article></body>",
    "<body><div class='has-menu'><div><main class='search-enabled'>{}</main></div></div></body>",
    "<body class='has-menu'>{menu}<div id=text>{}</div><div class=footer>imprint</div></body>",
    "<body><form id='aspnetForm' class='search-enabled'>{menu}<div class=no-sidebar><div id=text>{}</div></div></form><footer>imprint</footer></body>",
]


@pytest.mark.parametrize("page", AROUND)
def test_what_holds_the_text_does_not_leave_it_out(page):
    page = page.format(ENTRY, menu=MENU)
    want = "A title\nThe first words of an entry\nand some more of them"
    assert html.extract(page, None) == want
    assert html.extract(page, wrapper_of([page, page])) == want


def test_comments_stay_out_where_they_are_longer():
    page = f"<body><div id=text>{ENTRY}</div><div class=comments>{'a comment of many words ' * 20}</div></body>"
    assert html.extract(page, None) == "A title\nThe first words of an entry\nand some more of them"


NOTICE = "<div><p>Call us any time</p><p>for a quote today</p></div>"
OWN = "<div><p>Own words {n} of page {n} that differ a lot {n}</p><p>More of {n} and so on {n} again</p></div>"


def own_words(n):
    return f"Own words {n} of page {n} that differ a lot {n}\nMore of {n} and so on {n} again"


def test_fixed_texts_go_though_some_pages_lack_them():
    """An empty page, one of another layout and one with a text of its own in that place; the notice has two paragraphs."""
    pages = [f"<body><div id=c1>{NOTICE}{OWN.format(n=n)}</div></body>" for n in range(20)]
    pages += [None, "", "<body><table><tr><td>Other</td></tr></table></body>", f"<body><div id=c1><div><p>Closed</p><p>this week</p></div>{OWN.format(n=21)}</div></body>"]
    wrapper = wrapper_of(pages)
    assert [html.extract(p, wrapper) for p in pages[:20]] == [own_words(n) for n in range(20)]
    assert html.extract(pages[-4], wrapper) == ""


def test_fixed_texts_of_a_large_host():
    """Own paragraphs and the notice are one repeated group; far more texts than are counted at once."""
    pages = [f"<body><div id=c1><p>Call us any time</p>{''.join(f'<p>Own {n} {k}</p>' for k in range(5))}</div></body>" for n in range(400)]
    wrapper = wrapper_of(pages)
    assert len(wrapper.fixed) == 1
    assert all(html.extract(p, wrapper) == "\n".join(f"Own {n} {k}" for k in range(5)) for n, p in enumerate(pages))


def test_copies_of_a_page_are_not_all_fixed():
    pages = [f"<body><div id=c1>{OWN.format(n=1)}</div></body>"] * 4
    assert html.extract(pages[0], wrapper_of(pages)) == own_words(1)


NEUTRAL = "<body><div><ul><li><a href=x>Home</a></li><li><a href=y>News of today</a></li></ul></div><div>{notice}</div><div><h2>{title}</h2>{text}</div><div>{foot}</div></body>"


def neutral(n):
    """No tag or class tells anything; a page's own text is shorter than the notice and the foot."""
    notice = "A notice with many words that stands on every page of the host and says where to call for a quote today or any other day of the week"
    text = "".join(f"<p>Text {n} {k}</p>" for k in range(n % 4 + 1))
    foot = "Imprint, with a long address and some more words that are the same on all pages, and the law that says so"
    return NEUTRAL.format(notice=notice, title=f"Title {n}", text=text, foot=foot), "\n".join([f"Title {n}", *[f"Text {n} {k}" for k in range(n % 4 + 1)]])


def test_the_wrapper_decides():
    """Right with the wrapper, and wrong without it."""
    pages = [neutral(n) for n in range(12)]
    wrapper = wrapper_of([p for p, _ in pages])
    for page, want in pages:
        assert html.extract(page, wrapper) == want
        assert html.extract(page, None) != want


def test_neutral_pages_of_the_table(spark, sf):
    """The table's pages with all tags and classes that tell something taken away."""
    from tests.llm.test_brute_force import article_of

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    bare = [(r["page_id"], r["url"], re.sub(r' (class|id)="[^"]*"', "", re.sub(r"<(/?)(article|main|nav|footer|aside|header)\b[^>]*>", r"<\1div>", r["html"]))) for r in rows]
    found = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    assert sum(found[r["page_id"]] == article_of(r["html"]) for r in rows) >= 0.98 * len(rows)


@pytest.mark.parametrize("lost", ['<h2 id="related-work">Related work</h2>', '<h2 class="search">Search</h2>', '<p class="ad-hoc">Related work</p>', '<section id="search-algorithms">Related work</section>', "<p>a <math><mi>x</mi></math> b</p>", "<p>a <object>x</object></p>"])
def test_texts_of_an_article_stay(lost):
    text = " ".join(re.sub("<[^>]+>", " ", lost).split())
    page = f"<body><article><h1>t</h1>{lost}<p>end</p></article></body>"
    for wrapper in (None, wrapper_of([page])):
        assert html.extract(page, wrapper).replace("ax", "a x") == f"t\n{text}\nend"


def random_page(rng):
    """A small page: nested blocks with texts, some of them repeated."""
    def block(depth):
        tag = rng.choice(["div", "ul", "section", "table"] if depth < 3 else ["p"])
        if tag == "p" or rng.random() < 0.3:
            return f"<p>{rng.randint(0, 99)}</p>"
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{rng.randint(0, 99)}</li>" for _ in range(rng.randint(1, 3))) + "</ul>"
        turn = [block(depth + 1) for _ in range(rng.randint(1, 3))]
        return f"<{tag}>" + "".join(turn * rng.randint(1, 3)) + f"</{tag}>"

    return "<body>" + "".join(block(0) for _ in range(rng.randint(1, 4))) + "</body>"


def expression(nodes):
    """A wrapper as a regular expression over such streams."""
    out = ""
    for symbol, many, optional, parts, *_ in nodes:
        inside = "#" if symbol == "#" else expression(parts) if symbol[0] == "(" else f"<{symbol}>{expression(parts)}</{symbol}>"
        out += f"(?:{inside}){'*' if many and optional else '+' if many else '?' if optional else ''}"
    return out


def test_wrappers_are_expressions_of_their_pages():
    """Every page of a host is a word of the host's union-free expression, by a matcher that tries everything."""
    rng = random.Random(6)
    for _ in range(150):
        pages = [random_page(rng) for _ in range(rng.randint(1, 5))]
        form = expression(wrapper_of(pages).parts)
        assert "|" not in form
        for p in pages:
            tokens = re.sub(r"(?<=>)\d+(?=<)", "#", p)
            assert re.fullmatch(form, tokens), (p, form)


def test_groups_of_any_length_fold():
    turn = "<h2>t</h2><p>a</p><ul><li>b</li></ul><div><p>c</p></div><table><tr><td>d</td></tr></table><blockquote><p>e</p></blockquote><dl><dt>f</dt></dl><section><p>g</p></section>"
    parts = html.Page("<body>" + turn * 3 + "</body>").parts[0][html.KIDS]
    assert len(parts) == 1 and html.is_group(parts[0]) and len(parts[0][html.KIDS]) == 8


def test_long_optional_runs_do_not_disturb():
    """However many parts only one side has."""
    tags = ["div", "ul", "section", "dl", "blockquote", "table", "figure"]
    more = "".join(f"<{t}>{'<p>x</p><hr>' if k % 2 else '<h3>x</h3>'}</{t}>" for k, t in enumerate(tags * 9))
    pages = [f"<body><div><h1>T{n}</h1><p>own {n} words</p></div>{more if n == 3 else ''}<footer>f</footer></body>" for n in range(6)]
    wrapper = wrapper_of(pages)
    assert [html.extract(p, wrapper) for p in pages[:3]] == [f"T{n}\nown {n} words" for n in range(3)]


def test_partitions_make_no_difference(spark):
    """The wrappers are the same, and as infer() gives them, however pages are dealt; also where they are joined by shuffle."""
    rng = random.Random(8)
    pages = [(k, f"http://h{k % 3}.example/{k}", neutral(k)[0] if k % 2 else random_page(rng)) for k in range(90)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = [{r["host"]: r["wrapper"] for r in html.wrappers(df.repartition(n).sortWithinPartitions("html"), fan_in=4).collect()} for n in (1, 7)]
    assert found[0] == found[1]
    for host, text in found[0].items():
        assert html.Wrapper(text).parts == html.infer([p for _, u, p in pages if html.host_of(u) == host], fan_in=4).parts
    texts = [sorted(html.extract_pages(df.repartition(5), max_broadcast=bound).collect()) for bound in (html.MAX_BROADCAST, 0)]
    assert texts[0] == texts[1]
