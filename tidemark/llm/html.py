"""HTML main text by wrappers inferred from the pages of a host.

A page is a tree of blocks and texts. In each block, neighbouring parts of equal structure fold into one repeated part, runs
of parts that come again into a repeated group, whatever their length. The folded tree, its shape, is a regular
expression without unions: sequences, repeated parts and groups, text slots. The shapes of a host are aligned with each other, block within
block, so that as many parts as possible meet: what meets becomes one part, what only one side has becomes optional.

The wrapper says where a host's article is. Each slot weighs as many words as it has on all pages, less those of texts that most pages
have alike, and less repeated links. The main part is the smallest one that holds most of the weight, and every article or main element, in
both cases without what is a menu, header, footer, sidebar, notice, advert, form or comment by its element or, as a
second sign, by a whole word of its class; such a part counts all the same if the host's text is in it. A page is
aligned with its host's wrapper and each of its texts takes the verdict of the slot that it meets.

All pages take part. The first scan gives the shapes and the words of their slots, added up in each partition and then by key. Equal shapes are one, so
what is aligned are distinct shapes, in an order that doesn't depend on partitions: those of a host in groups of about
FAN_IN by their hash, the wrappers of these groups again in groups, and so on, so that no task gathers a host. The second scan extracts,
with the wrappers as a table if that is below MAX_BROADCAST bytes and joined by host otherwise.
"""

from __future__ import annotations

import html
import json
import re
import uuid
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table

#: Shapes or partial wrappers of a host that a task aligns, about.
FAN_IN = 64
MAX_BROADCAST = 16 << 20
#: Rows of an alignment that are kept at once; of the others every so many-th is.
ROWS = 256
#: Pages with the same text that make it a fixed one, if they are most of those with a text in that place.
FIXED = 3
#: Words that a word of a first heading counts for: a heading tells where an article is.
HEADING = 10
#: Deeper blocks don't nest further; browsers have such a bound, too. No text is lost by it.
DEPTH = 100
#: Entries that a task holds before it passes them on.
HELD = 200_000

# Elements by what they are to a text.
CONTAINERS = set("body div section article main aside nav header footer form ul ol dl table figure blockquote details dialog menu fieldset hgroup search".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Parts of a list or of running text: neighbours are one repeated part, whatever is in them.
RUNNING = HEADINGS | set("p li dt dd pre address".split())
BLOCKS = CONTAINERS | RUNNING | set("tr td th caption figcaption legend summary center option title".split())
#: Blocks that only end a line.
BREAKS = set("br hr html thead tbody tfoot".split())
#: Their content is no text of the page; the last ones stand within a line.
RAW = set("script style noscript template iframe head noframes xmp textarea svg select button".split())
RAW_INLINE = set("textarea svg select button".split())
KNOWN = BLOCKS | BREAKS | RAW | {"a"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that the start of another ends, as far as the next container.
ENDED_BY = {**{x: {"p"} | HEADINGS for x in BLOCKS | {"hr"}}, "li": {"li", "p"} | HEADINGS, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}
#: Never part of an article.
LEFT_OUT = set("nav aside footer form menu dialog fieldset search".split())
ARTICLE = {"article", "main"}
#: Words of class, id or role that tell the same, and words that say nothing beside them.
TELLING = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "comment comments commentlist menubar topnav subnav navmenu sidemenu respond reply replies disqus discussion notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations widget toolbar pagination pager skip skiplink complementary contentinfo search".split()
)
GENERIC = set("site page main top bottom left right header box area bar list wrapper wrap container inner outer block section panel item items link links button buttons user users reader post posts article articles global primary secondary form text content".split())
#: Elements whose id may tell; elsewhere it names a place in the text.
WITH_ID = set("div aside ul ol table header footer nav form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in RAW}
_BODY = re.compile(r"(?=<body)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)")

TEXT = "#"
#: After a tag: it tells that it's left out; it is a header, which tells so outside an article.
TOLD, HEADER = "!", "^"
#: Places in a node.
SYMBOL, MANY, OPTIONAL, KIDS, WORDS = range(5)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].rpartition("@")[2].lower() if found else ""


def _symbol(tag: str, rest: str) -> str:
    """A block as its tag and what it tells. Only whole words of its class, role or id tell, with general ones beside them:
    comment-list does, ad-hoc doesn't; those of a heading or of the body never do."""
    if tag in LEFT_OUT:
        return tag + TOLD
    if rest and tag != "body" and tag not in HEADINGS:
        if "hidden" in rest and _HIDDEN.search(rest) and tag not in ARTICLE:
            return tag + TOLD
        for m in _ATTRIBUTE.finditer(rest):
            if m[1].lower() == "id" and tag not in WITH_ID:
                continue
            for name in (m[2] or m[3] or m[4] or "").split():
                words = {x.lower() for x in _PART.findall(name)}
                if words <= TELLING | GENERIC and words & TELLING:
                    return tag + TOLD
                if "header" in words and words <= GENERIC and tag not in ARTICLE and not words & {"post", "article", "content", "text"}:
                    return tag + HEADER
    return tag + HEADER if tag == "header" and not any(x in rest for x in ("entry", "post", "article", "content", "story")) else tag


class Page:
    """shape: the folded tree, nodes [symbol, repeated, optional, parts]. slots: for each text slot of the shape, in order, the
    texts in it. texts: (text, words, words in links)."""

    def __init__(self, source: str | None):
        self.texts: list[tuple[str, int, int]] = []
        root: list = ["", False, False, []]
        stack, tags, ids = [root], [""], {}
        held: list[str] = []
        links = in_link = 0

        def flush():
            nonlocal links
            if held:
                words = "".join(held).split()
                held.clear()
                if words:
                    stack[-1][KIDS].append([TEXT, False, False, [], [len(self.texts)]])
                    self.texts.append((" ".join(words), len(words), links))
                links = 0

        def ended():
            node = stack.pop()
            tags.pop()
            node[KIDS] = fold(node[KIDS], ids)

        source, at = source or "", 0
        while m := _TOKEN.match(source, at):
            at, kind = m.end(), m.lastgroup
            if kind == "text" or kind == "data":
                text = m[kind]
                held.append(html.unescape(text) if kind == "text" and "&" in text else text)
                if in_link:
                    links += len(text.split())
                continue
            if kind is None:
                continue
            close, tag, rest = m.group("close", "tag", "rest") if kind == "rest" else m.group("close2", "tag2", "rest2")
            tag = tag.lower()
            if tag not in KNOWN and not rest and (not close or tag not in tags):
                continue
            if tag in RAW:
                if not close and not rest.endswith("/"):
                    end = _RAW_END[tag].search(source, at)
                    # A head without its end is closed by the body.
                    end = _BODY.search(source, at) if end is None and tag == "head" else end
                    at = end.end() if end else len(source) if tag != "head" else at
                if tag not in RAW_INLINE:
                    flush()
                continue
            if tag == "a":
                in_link = not close
            if tag in BREAKS:
                flush()
                if tag != "hr" or close:
                    continue
            block = tag in BLOCKS
            symbol = tag
            if not close and (block or (rest and tag not in VOID)):
                symbol = _symbol(tag, rest)
                # Within a line, only what is left out is a part of its own.
                block = block or symbol[-1] == TOLD
            if close:
                if tag in tags:
                    flush()
                    while tags[-1] != tag:
                        ended()
                    ended()
                elif block:
                    flush()
                continue
            if not block and tag != "hr":
                continue
            flush()
            if enders := ENDED_BY.get(tag):
                k = len(tags) - 1
                last = None
                while k > 0 and tags[k] not in CONTAINERS:
                    last = k if tags[k] in enders else last
                    k -= 1
                while last is not None and len(tags) > last:
                    ended()
            if tag in ARTICLE and not ARTICLE.intersection(tags):
                # What should have been closed before an article doesn't hold it.
                while len(stack) > 1 and stack[-1][SYMBOL][-1] == TOLD and tags[-1] != "form":
                    ended()
            if tag == "hr" or tag in VOID or rest.endswith("/") or len(stack) > DEPTH:
                continue
            node = [symbol, False, False, []]
            stack[-1][KIDS].append(node)
            stack.append(node)
            tags.append(tag)
        flush()
        while len(stack) > 1:
            ended()
        root[KIDS] = fold(root[KIDS], ids)
        self.parts = root[KIDS]
        self.slots: list[list[int]] = []
        self.shape = f"[{self._written(self.parts)}]"

    def _written(self, nodes: list) -> str:
        """The shape as JSON; gathers the slots on the way."""
        out = []
        for x in nodes:
            if x[SYMBOL] == TEXT:
                self.slots.append(x[WORDS])
                inside = ""
            else:
                inside = self._written(x[KIDS])
            out.append(f'["{x[SYMBOL]}",{"true" if x[MANY] else "false"},{"true" if x[OPTIONAL] else "false"},[{inside}]]')
        return ",".join(out)


def leaves(nodes: list, path: tuple = ()):
    """(path, node) of the text slots in order; a path is of nodes."""
    for x in nodes:
        if x[SYMBOL] == TEXT:
            yield path, x
        else:
            yield from leaves(x[KIDS], (*path, x))


def is_group(node: list) -> bool:
    return node[SYMBOL][:1] == "("


def fold(nodes: list, ids: dict) -> list:
    """Parts of a block with neighbours of equal structure as one, and runs of two or more parts that come again as groups,
    the shortest runs first. `ids` numbers structures."""
    if len(nodes) < 2:
        return nodes

    def structure(x: list) -> int:
        tag = x[SYMBOL]
        key = tag if tag in RUNNING or tag.rstrip(TOLD) in RUNNING else (tag, *map(structure, x[KIDS]))
        return ids.setdefault(key, len(ids))

    out, kinds = [], []
    for x in nodes:
        kind = structure(x)
        if kinds and kinds[-1] == kind:
            last, own = out[-1][KIDS], x[KIDS]
            if len(last) == len(own) == 1 and last[0][SYMBOL] == own[0][SYMBOL] == TEXT:
                # As merged() does, without a copy.
                last[0][WORDS] += own[0][WORDS]
                last[0][MANY] = last[0][MANY] or own[0][MANY]
            else:
                out[-1] = merged(out[-1], x)
            out[-1][MANY] = True
        else:
            out.append(x)
            kinds.append(kind)
    n = 2
    while 2 * n <= len(out) and len(set(kinds)) < len(kinds):
        codes = np.array(kinds)
        # How many places from each on are equal to those n further.
        equal = np.append(codes[:-n] == codes[n:], False)
        stops = np.flatnonzero(~equal)
        run = stops[np.searchsorted(stops, np.arange(len(equal)))] - np.arange(len(equal))
        first = int(np.argmax(run >= n)) if (run >= n).any() else None
        if first is None:
            n += 1
            continue
        turns = int(run[first]) // n + 1
        members = out[first : first + n]
        for k in range(1, turns):
            members = [merged(a, b) for a, b in zip(members, out[first + k * n : first + (k + 1) * n], strict=True)]
        group = [f"({','.join(x[SYMBOL] for x in members)})", True, False, members]
        out[first : first + turns * n] = [group]
        kinds[first : first + turns * n] = [ids.setdefault(("(", *kinds[first : first + n]), len(ids))]
        n = 2
    return out


def merged(a: list, b: list) -> list:
    """Two nodes of one symbol as one."""
    out = [a[SYMBOL], a[MANY] or b[MANY], a[OPTIONAL] or b[OPTIONAL], a[KIDS] if a[SYMBOL] == TEXT else merged_parts(a[KIDS], b[KIDS])]
    if len(a) > WORDS:
        # Numbers of texts in a page, or sums over pages.
        out.append(a[WORDS] + b[WORDS] if isinstance(a[WORDS], list) else tuple(x + y for x, y in zip(a[WORDS], b[WORDS], strict=True)))
    return out


def merged_parts(a: list, b: list) -> list:
    out = []
    for i, n, j, m in align(a, b):
        if not n or not m:
            out += [[x[SYMBOL], x[MANY], True, *x[KIDS:]] for x in (a[i : i + n] or b[j : j + m])]
        elif n == m == 1:
            out.append(merged(a[i], b[j]))
        else:
            group, turn = (a[i], b[j : j + m]) if n == 1 else (b[j], a[i : i + n])
            members = [merged(x, [*y[:OPTIONAL], False, *y[KIDS:]]) for x, y in zip(group[KIDS], turn, strict=True)]
            members = [[*x[:OPTIONAL], x[OPTIONAL] or y[OPTIONAL], *x[KIDS:]] for x, y in zip(members, turn, strict=True)]
            out.append([group[SYMBOL], True, group[OPTIONAL] or all(y[OPTIONAL] for y in turn), members])
    return out


def align(a: list, b: list) -> list[tuple[int, int, int, int]]:
    """(i, n, j, m): n parts of a from i on meet m of b from j on, in order; n or m is 0 where the other side has none. Parts
    meet if their symbols are equal; a group also meets a run of parts that is one turn of it. Of all alignments it is
    one in which most parts meet, those within the parts counted."""
    x, y, codes = _coded(a, b)
    if x == y and len(set(x)) == len(x):
        return [(k, 1, k, 1) for k in range(len(x))]
    return _best(a, x, b, y, codes)[1]


def _coded(a: list, b: list) -> tuple[list[int], list[int], dict[str, int]]:
    codes: dict[str, int] = {}
    x, y = ([codes.setdefault(node[SYMBOL], len(codes)) for node in nodes] for nodes in (a, b))
    return x, y, codes


def _turns(nodes: list, codes: dict) -> dict[int, list[int]]:
    return {k: [codes.get(m[SYMBOL], -1) for m in node[KIDS]] for k, node in enumerate(nodes) if is_group(node)}


def _gain(a: list, b: list) -> int:
    """How many parts of two nodes of one symbol meet."""
    if a[SYMBOL] == TEXT or a[SYMBOL].rstrip(TOLD) in RUNNING:
        return 1
    x, y, codes = _coded(a[KIDS], b[KIDS])
    if x == y and len(set(x)) == len(x):
        return 1 + sum(map(_gain, a[KIDS], b[KIDS]))
    return 1 + _best(a[KIDS], x, b[KIDS], y, codes)[0]


def _best(left: list, a: list[int], right: list, b: list[int], codes: dict) -> tuple[int, list[tuple[int, int, int, int]]]:
    """How many parts meet at most, and align(), by dynamic programming from the ends of both. ROWS rows are held at once: of the others only those that
    a block of rows is computed again from."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0, [(k, 1, 0, 0) for k in range(n)] + [(0, 0, k, 1) for k in range(m)]
    at, mine, theirs = np.array(b, np.int64), _turns(left, codes), _turns(right, codes)
    deepest = max([1, *(len(t) for t in theirs.values())])
    known: dict[int, list] = {}

    def moves(i):
        """(rows and columns further, parts that meet, columns where they do) of row i."""
        if i not in known:
            found = []
            columns = np.flatnonzero(at == a[i])
            if len(columns):
                found.append((1, 1, np.array([_gain(left[i], right[j]) for j in columns.tolist()], np.int64), columns))
            if (turn := mine.get(i)) and len(turn) <= m:
                fits = np.logical_and.reduce([at[x : m - len(turn) + 1 + x] == code for x, code in enumerate(turn)])
                columns = np.flatnonzero(fits)
                found.append((1, len(turn), np.full(len(columns), len(turn)), columns))
            for j, turn in theirs.items():
                if a[i : i + len(turn)] == turn:
                    found.append((len(turn), 1, np.array([len(turn)]), np.array([j])))
            known[i] = found
        return known[i]

    def rows(stop, below):
        """By row and column, how many parts meet from there on: rows of the block before `stop`, and `below`."""
        out = dict(below)
        for i in range(stop - 1, max(0, stop - ROWS) - 1, -1):
            row = out[i + 1].copy()
            for down, right_by, gain, columns in moves(i):
                row[columns] = np.maximum(row[columns], out[i + down][columns + right_by] + gain)
            out[i] = np.maximum.accumulate(row[::-1])[::-1]
        return out

    below, blocks, score = {n: np.zeros(m + 1, np.int64)}, [], {}
    for stop in range(n, 0, -ROWS):
        blocks.append((stop, below))
        score = rows(stop, below)
        first = max(0, stop - ROWS)
        below = {k: score[k] for k in range(first, min(n, first + deepest) + 1)}
    most = int(score[0][0])
    out: list[tuple[int, int, int, int]] = []
    i = j = 0
    stop = blocks.pop()[0]
    while i < n and j < m:
        if i >= stop:
            while i >= stop:
                stop, below = blocks.pop()
            score = rows(stop, below)
        for down, right_by, gain, columns in moves(i):
            k = int(np.searchsorted(columns, j))
            if k < len(columns) and columns[k] == j and score[i][j] == score[i + down][j + right_by] + gain[k]:
                out.append((i, down, j, right_by))
                i, j = i + down, j + right_by
                break
        else:
            if score[i][j] == score[i + 1][j]:
                out.append((i, 1, j, 0))
                i += 1
            else:
                out.append((i, 0, j, 1))
                j += 1
    return most, out + [(k, 1, m, 0) for k in range(i, n)] + [(n, 0, k, 1) for k in range(j, m)]


def met(wrapper: list, parts: list):
    """(slot of the wrapper, slot of the page) where they meet."""
    for i, n, j, m in align(wrapper, parts):
        if not n or not m:
            continue
        a, b = (wrapper[i : i + n], parts[j : j + m]) if n == m else (wrapper[i][KIDS], parts[j : j + m]) if n == 1 else (wrapper[i : i + n], parts[j][KIDS])
        for x, y in zip(a, b, strict=True):
            if x[SYMBOL] == TEXT:
                yield x, y
            else:
                yield from met(x[KIDS], y[KIDS])


def aligned_all(wrappers: list[tuple[int, str]]) -> tuple[int, list]:
    """(pages, parts) of all (pages, JSON of parts): the most frequent first, then by text, whatever their order."""
    pages, out = 0, []
    for n, text in sorted(wrappers, key=lambda w: (-w[0], w[1])):
        parts = _read(json.loads(text))
        out = merged_parts(out, parts) if pages else parts
        pages += n
    return pages, out


def _read(nodes: list) -> list:
    return [[*x[:KIDS], _read(x[KIDS]), *[tuple(w) for w in x[WORDS:]]] for x in nodes]


def with_words(shape: str, words: list) -> str:
    """A shape with the sums of its slots, in order: (texts, words, words in links, words of fixed texts)."""
    parts = json.loads(shape)
    for (_, leaf), sums in zip(leaves(parts), words, strict=True):
        leaf.append(sums)
    return json.dumps(parts, separators=(",", ":"))


class Main:
    """Judges the slots of a wrapper: `verdicts` by the slot's number.

    A slot is main if it is in an article or main element, or, unless these hold half of the weight, in the smallest part that
    holds most of it; but not in what tells that it's left out. A part doesn't tell if it holds half of all words and next to nothing (a tenth of that) is
    left without it; an article or what is around articles not if it holds half of their words, or if all articles are in such parts.
    `others` are the verdicts for pages that have no article."""

    def __init__(self, parts: list):
        found = list(leaves(parts))
        self.paths = [path for path, _ in found]
        sums = [leaf[WORDS] for _, leaf in found]
        self.words = [w for _, w, _, _ in sums]
        own = [w - fixed for _, w, _, fixed in sums]
        # Copies of one page: everything is fixed.
        own = own if any(own) else self.words
        listed = [2 * links >= w and any(x[MANY] for x in path) for path, (_, w, links, _) in zip(self.paths, sums, strict=True)]
        weights = [0 if links else w * (HEADING if any(x[SYMBOL] == "h1" for x in path) else 1) for path, w, links in zip(self.paths, own, listed, strict=True)]
        self.silent: set[int] = set()
        if any(map(self._telling, self.paths)):
            self._hush()
        usable = [not self._telling(path) for path in self.paths]
        inside = [_article(path) < len(path) for path in self.paths]
        marked = [u and x for u, x in zip(usable, inside, strict=True)]
        of_articles = sum(w for w, x in zip(weights, marked, strict=True) if x)
        elsewhere = sum(w for w, u, x in zip(weights, usable, inside, strict=True) if u and not x)
        root = self._root(weights, [u and not x for u, x in zip(usable, inside, strict=True)])
        self.others = [u and not x and not links and root <= _ids(path) for path, u, x, links in zip(self.paths, usable, inside, listed, strict=True)]
        if any(marked) and of_articles >= elsewhere:
            self.verdicts = marked
        else:
            root = self._root(weights, usable)
            self.verdicts = [x or (u and not links and root <= _ids(path)) for path, u, x, links in zip(self.paths, usable, marked, listed, strict=True)]
        self.in_article = inside

    def _root(self, weights: list[int], usable: list[bool]) -> set[int]:
        mass: dict[int, int] = defaultdict(int)
        whole, depth, path_of, plain = 0, {}, {}, set()
        for path, w, u in zip(self.paths, weights, usable, strict=True):
            if u:
                whole += w
                heading = any(x[SYMBOL] in HEADINGS for x in path)
                for k, x in enumerate(path):
                    mass[id(x)] += w
                    depth[id(x)], path_of[id(x)] = k, path[: k + 1]
                    if w and not heading:
                        plain.add(id(x))
        # Running text is no place of its own, and what has nothing but headings only if there is nothing else.
        most = [k for k, w in mass.items() if whole and 10 * w >= 7 * whole and path_of[k][-1][SYMBOL].rstrip(TOLD) not in RUNNING and (k in plain or not plain)]
        return _ids(path_of[max(most, key=lambda k: depth[k])]) if most else set()

    def _hush(self) -> None:
        articles = [(path, w, self._telling(path[: _article(path) + 1])) for path, w in zip(self.paths, self.words, strict=True) if _article(path) < len(path) and len(self._telling(path)) == len(self._telling(path[: _article(path) + 1]))]
        if articles:
            held: dict[int, int] = defaultdict(int)
            for _, w, outer in articles:
                for x in outer:
                    held[x] += w
            whole = sum(w for _, w, _ in articles)
            self.silent = {x for x, w in held.items() if 2 * w >= whole}
            if all(set(outer) - self.silent for _, _, outer in articles):
                self.silent = set(held)
            return
        whole = sum(self.words)
        while True:
            held, usable = defaultdict(int), 0
            for path, w in zip(self.paths, self.words, strict=True):
                if outer := self._telling(path):
                    held[outer[0]] += w
                else:
                    usable += w
            # The first of the heaviest, in the order of the page.
            most = max(held, key=held.__getitem__, default=None)
            if most is None or (usable and (2 * held[most] < whole or 10 * usable >= held[most])):
                return
            self.silent.add(most)

    def _telling(self, path) -> list[int]:
        """The parts of a path, by their identity, that tell that it's left out."""
        out, in_article = [], False
        for x in path:
            if id(x) not in self.silent and (x[SYMBOL][-1] == TOLD or (x[SYMBOL][-1] == HEADER and not in_article)):
                out.append(id(x))
            in_article = in_article or x[SYMBOL].rstrip(TOLD) in ARTICLE
        return out


def _ids(path) -> set[int]:
    return {id(x) for x in path}


def _article(path) -> int:
    """The place of the outermost article or main element; the path's length without one."""
    return next((k for k, x in enumerate(path) if x[SYMBOL].rstrip(TOLD) in ARTICLE), len(path))


def place_of(path) -> int:
    """A hash of the elements that a slot is in, groups left out."""
    return xxhash.xxh64_intdigest("/".join(x[SYMBOL] for x in path if not is_group(x))) >> 1


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


def finished(parts: list, fixed: list) -> str:
    """A wrapper as JSON: its parts, whose slots have the verdicts (main, main on a page without articles, in an article), and
    the fixed texts as (place, digest)."""
    main = Main(parts)
    for k, (_, leaf) in enumerate(leaves(parts)):
        leaf[WORDS:] = [(main.verdicts[k], main.others[k], main.in_article[k])]
    return json.dumps([parts, sorted([a, b] for a, b in fixed)], separators=(",", ":"))


class Wrapper:
    """What the second scan asks of a host's wrapper."""

    def __init__(self, text: str):
        parts, fixed = json.loads(text)
        self.parts, self.fixed = _read(parts), {(a, b) for a, b in fixed}
        self.by_shape: dict[str, list] = {}

    def verdicts(self, page: Page) -> list:
        """For each slot of the page, the verdicts of the slot that it meets, None if it meets none, and its place."""
        if page.shape not in self.by_shape:
            if len(self.by_shape) > 1000:
                self.by_shape.clear()
            own = list(leaves(page.parts))
            number, found = {id(leaf): k for k, (_, leaf) in enumerate(own)}, [None] * len(own)
            for slot, leaf in met(self.parts, page.parts):
                found[number[id(leaf)]] = slot[WORDS]
            self.by_shape[page.shape] = [(v, place_of(path)) for v, (path, _) in zip(found, own, strict=True)]
        return self.by_shape[page.shape]


def _own(page: Page) -> list:
    """The verdicts of a page alone."""
    parts = _read(json.loads(with_words(page.shape, [[len(s), *(sum(page.texts[k][x] for k in s) for x in (1, 2)), 0] for s in page.slots])))
    main = Main(parts)
    return list(zip(main.verdicts, main.others, main.in_article, strict=True))


def extract(source: str | None, wrapper: Wrapper | None) -> str:
    """The main text, one block a line."""
    page = Page(source)
    if not page.texts:
        return ""
    verdicts, places = zip(*wrapper.verdicts(page), strict=True) if wrapper else (_own(page), ())
    if None in verdicts:
        verdicts = [v or own for v, own in zip(verdicts, _own(page), strict=True)]
    # 0, or 1 if the page has no article.
    of = 0 if any(v[0] for v in verdicts) else 1
    main = sorted(k for slot, v in zip(page.slots, verdicts, strict=True) if v[of] for k in slot)
    if wrapper and wrapper.fixed:
        gone = {k for place, slot, v in zip(places, page.slots, verdicts, strict=True) if v[of] and not v[2] for k in slot if (place, digest(page.texts[k][0])) in wrapper.fixed}
        # A page that most pages are copies of isn't all fixed.
        main = [k for k in main if k not in gone] or main
    return "\n".join(page.texts[k][0] for k in main)


def infer(sources: list[str | None], fan_in: int = FAN_IN) -> Wrapper:
    """The wrapper of one host's pages, as wrappers() infers it, without Spark."""
    shapes: dict[str, list] = {}
    texts, pages_of = defaultdict(int), defaultdict(int)
    for page in map(Page, sources):
        if page.texts:
            shapes.setdefault(page.shape, []).append(page)
            found = [(place_of(path), {digest(page.texts[k][0]) for k in slot}) for (path, _), slot in zip(leaves(page.parts), page.slots, strict=True)]
            for key in {(place, d) for place, ds in found for d in ds}:
                texts[key] += 1
            for place in {place for place, _ in found}:
                pages_of[place] += 1
    fixed = [key for key, n in texts.items() if n >= FIXED and 2 * n > pages_of[key[0]]]
    parts = []
    for shape, pages in shapes.items():
        sums = [[0, 0, 0, 0] for _ in pages[0].slots]
        for page in pages:
            for got, (path, _), slot in zip(sums, leaves(page.parts), page.slots, strict=True):
                for k in slot:
                    content, words, links = page.texts[k]
                    for x, more in enumerate((1, words, links, words if (place_of(path), digest(content)) in fixed else 0)):
                        got[x] += more
        parts.append((digest(shape), len(pages), with_words(shape, sums)))
    buckets = 1
    while buckets * fan_in < len(parts):
        buckets *= fan_in
    while parts:
        groups = defaultdict(list)
        for bucket, n, text in parts:
            groups[bucket % buckets].append((n, text))
        joined = {bucket: aligned_all(group) for bucket, group in groups.items()}
        parts = [(bucket, n, json.dumps(x, separators=(",", ":"))) for bucket, (n, x) in joined.items()]
        if buckets == 1:
            break
        buckets //= fan_in
    return Wrapper(finished(_read(json.loads(parts[0][2])) if parts else [], fixed))


SLOTS = "host string, shape long, slot int, place long, digest long, n long, words long, links long, text string"
#: In the column slot: a shape's row, with its number of pages and its text; a place's row, with its number of pages.
SHAPE, PLACE = -1, -2


def _scanned(batches):
    """Of rows (url, html): SLOTS rows, added up."""
    sums: dict[tuple, list[int]] = {}
    texts: dict[tuple, str] = {}
    places_of: dict[str, tuple[int, list[int]]] = {}

    def add(key, n, words=0, links=0):
        got = sums.get(key)
        if got is None:
            sums[key] = [n, words, links]
        else:
            got[0], got[1], got[2] = got[0] + n, got[1] + words, got[2] + links

    def passed():
        keys = list(sums)
        for i in range(0, len(keys), 20_000):
            some = keys[i : i + 20_000]
            columns = [pa.array([k[0] for k in some], pa.string()), pa.array([k[1] for k in some], pa.int64()), pa.array([k[2] for k in some], pa.int32())]
            columns += [pa.array([k[x] for k in some], pa.int64()) for x in (3, 4)]
            columns += [pa.array([sums[k][x] for k in some], pa.int64()) for x in (0, 1, 2)]
            columns.append(pa.array([texts[k[:2]] if k[2] == SHAPE else None for k in some], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SLOTS.split(", ")])
        sums.clear()
        texts.clear()

    for batch in batches:
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = Page(source.as_py())
            if not page.texts:
                continue
            host, text = host_of(url), page.shape
            if text not in places_of:
                if len(places_of) > 1000:
                    places_of.clear()
                places_of[text] = digest(text), [place_of(path) for path, _ in leaves(page.parts)]
            shape, places = places_of[text]
            texts[host, shape] = text
            add((host, shape, SHAPE, None, None), 1)
            for k, (place, slot) in enumerate(zip(places, page.slots, strict=True)):
                once: dict[int, list[int]] = {}
                for x in slot:
                    content, words, links = page.texts[x]
                    got = once.setdefault(digest(content), [0, 0])
                    got[0], got[1] = got[0] + words, got[1] + links
                for d, (words, links) in once.items():
                    add((host, shape, k, place, d), 1, words, links)
            for place in set(places):
                add((host, None, PLACE, place, None), 1)
            if len(sums) > HELD:
                yield from passed()
    yield from passed()


def _grouped(rows: pd.DataFrame) -> pd.DataFrame:
    """A group of a host's wrappers as one."""
    pages, parts = aligned_all(list(zip(rows["pages"].tolist(), rows["wrapper"], strict=True)))
    return pd.DataFrame({"host": [rows["host"].iat[0]], "bucket": [rows["bucket"].iat[0]], "pages": [pages], "wrapper": [json.dumps(parts, separators=(",", ":"))]})


def _worded(batches):
    """Rows (host, shape, pages, text, slots) with the shapes' slots filled in."""
    for batch in batches:
        filled = [with_words(text, slots) for text, slots in zip(batch.column(3).to_pylist(), ([[s["n"], s["words"], s["links"], s["fixed"]] for s in sorted(x, key=lambda s: s["slot"])] for x in batch.column(4).to_pylist()), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(filled, pa.string())], ["host", "bucket", "pages", "wrapper"])


def _judged(batches):
    """Rows (host, wrapper, fixed) with the wrappers' verdicts."""
    for batch in batches:
        done = [finished(_read(json.loads(text)), [(f["place"], f["digest"]) for f in fixed or []]) for text, fixed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], ["host", "wrapper"])


def wrappers(pages: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(host, wrapper): a JSON text of the wrapper of each host of `pages` (url, html)."""
    # Counts and hashes, and each shape's text once in a task.
    found = materialise(pages.select("url", "html").mapInArrow(_scanned, SLOTS))
    slots, places = found.filter("slot >= 0"), found.filter(F.col("slot") == PLACE)
    often = slots.groupBy("host", "place", "digest").agg(F.sum("n").alias("n")).filter(F.col("n") >= FIXED)
    of = places.groupBy("host", "place").agg(F.sum("n").alias("pages"))
    fixed = materialise(often.join(of, ["host", "place"]).filter("2 * n > pages").select("host", "place", "digest"))
    told = slots.join(fixed.withColumn("is_fixed", F.lit(True)), ["host", "place", "digest"], "left")
    sums = told.groupBy("host", "shape", "slot").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.sum("links").alias("links"), F.sum(F.when(F.col("is_fixed"), F.col("words")).otherwise(0)).alias("fixed"))
    # A row for each slot of a shape.
    of_shape = sums.groupBy("host", "shape").agg(F.collect_list(F.struct("slot", "n", "words", "links", "fixed")).alias("slots"))
    shapes = found.filter(F.col("slot") == SHAPE).groupBy("host", "shape").agg(F.sum("n").alias("pages"), F.min("text").alias("text"))
    rows = shapes.join(of_shape, ["host", "shape"]).select("host", "shape", "pages", "text", "slots")
    parts = materialise(rows.mapInArrow(_worded, "host string, bucket long, pages long, wrapper string"))
    most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    buckets = 1
    while buckets * fan_in < most:
        buckets *= fan_in
    while True:
        parts = parts.withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
        parts = parts.groupBy("host", "bucket").applyInPandas(_grouped, "host string, bucket long, pages long, wrapper string")
        if buckets == 1:
            break
        parts, buckets = materialise(parts), buckets // fan_in
    # Fewer texts than twice those of an average page of the host.
    by_host = fixed.groupBy("host").agg(F.collect_list(F.struct("place", "digest")).alias("fixed"))
    return parts.select("host", "wrapper").join(by_host, "host", "left").mapInArrow(_judged, "host string, wrapper string")


_wrappers: dict[tuple[str, str], Wrapper | None] = {}


def _extracting(key: str, table_of):
    """Rows (page_id, url, html, wrapper); the wrapper's column counts if no table is given."""

    def run(batches):
        known = table_of.value if table_of is not None else None
        for batch in batches:
            texts = []
            given = batch.column(3).to_pylist()
            for k, url in enumerate(batch.column(1).to_pylist()):
                host = host_of(url)
                if (key, host) not in _wrappers:
                    if len(_wrappers) > 500:
                        _wrappers.clear()
                    text = known.get(host) if known is not None else given[k]
                    _wrappers[key, host] = Wrapper(text) if text else None
                texts.append(extract(batch.column(2)[k].as_py(), _wrappers[key, host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html).

    Null and empty html give an empty text. Pages without a host in their url are of one host ''. A host of one page
    has that page as its wrapper. Repeated rows and null ids each give a row; an empty table gives none; further
    columns are ignored. Of parts that weigh the same the innermost counts, then the first of the page; shapes that as many pages have are
    taken in the order of their text.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html")
    found = materialise(wrappers(rows))
    size = found.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    kind = pages.schema["page_id"].dataType.simpleString()
    schema, key = f"page_id {kind}, url string, text string, n_chars long", uuid.uuid4().hex
    if size <= max_broadcast:
        known = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in found.toLocalIterator()})
        return rows.withColumn("wrapper", F.lit(None).cast("string")).mapInArrow(_extracting(key, known), schema)
    host = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), "^.*@", ""))
    return rows.withColumn("host", host).join(found, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(_extracting(key, None), schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
