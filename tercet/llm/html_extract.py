"""Main text of web pages by wrapper induction.

Pages of one host are parsed and aligned with a reference page by simple tree matching.  Nodes whose content is the
same on most differing pages are template; the varying slots are content.  What the markup itself declares (navigation,
forms, scripts, classes such as "sidebar") is template on any page, also where a host has a single one; where a page
marks its article, the content is taken from there.

Distinct pages are dealt out by host; hosts with more than a thousandth as many distinct pages as there are rows are
split, and a task induces wrappers over bounded groups of a host's distinct pages, one after another, so copies take no
part in the make-up of a group and all get the same text.  Two distinct pages of a host suffice.

Defined results: null and empty pages have an empty text; pages with a null url form a group like a host; repeated rows
give repeated rows; malformed markup (unclosed or crossed tags, cut-off entities) is read as browsers do, roughly; extra
columns are not read.  Blocks are separated by one line feed, white space in a block (also a br) is one space.
"""

from __future__ import annotations

import html
import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.llm.common import small_batches, stored

#: Distinct pages over which a wrapper is induced; pages aligned with a node before it counts as constant, where a group has more.
GROUP, LEAST = 256, 4
#: A node is template where it is the same on this share of the pages that it is aligned with.
CONSTANT = 0.6
#: A slot varies where it has so many other values for each page, besides one: copies leave some, a second menu does not.
VARIES = 0.1

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_CLASS = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Element names and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup html head body legend".split())
DROPPED = frozenset("head script style noscript template svg math iframe object embed canvas audio video nav footer aside form button select textarea input option datalist dialog menu noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot alert alerts banner bottombar breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dropdown footer gdpr "
    "header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommendations recommended related "
    "reply replies respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar tracking widget widgets".split()
)
ASIDES = frozenset("ad ads advert advertisement comment comments promo related replies reply sponsored teaser".split())
ARTICLE_MARKS = frozenset(("article", "post", "entry", "story", "content", "main", "body", "text"))
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}


class Node:
    """An element: name, label for alignment, texts and elements in order, and what its markup says about it."""

    __slots__ = ("tag", "label", "parts", "kids", "dropped", "key", "size", "own", "own_size", "shape", "nodes", "template")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.parts, self.kids, self.template = tag, [], [], False
        self.label, self.dropped, self.key = tag, tag in DROPPED, None
        if attrs and "=" in attrs or "hidden" in attrs:
            for name, *value in _CLASS.findall(attrs):
                v = "".join(value)
                name = name.lower()
                if name == "class":
                    self.label = f"{tag}.{v}"
                if name == "hidden" or name == "aria-hidden" and v == "true" and tag != "body":
                    self.dropped = True
                elif name == "role":
                    self.dropped |= v.lower() in ROLES
                elif tag in ("article", "main"):
                    self.dropped |= any(not ASIDES.isdisjoint(w.lower() for w in _WORDS.findall(token)) for token in v.split())
                elif tag not in ("html", "body") and name in ("class", "id"):
                    self.dropped |= any(marked(token) for token in v.split())


def marked(token: str) -> bool:
    """Whether a class or id names something that is not content: its last word or first does."""
    found = [w.lower() for w in _WORDS.findall(token)]
    if not found or found[0] in ("no", "has", "with", "without"):
        return False
    return found[0] in MARKS and not (len(found) > 1 and found[-1] in ARTICLE_MARKS) or found[-1] in MARKS and not found[0] in ("article", "post", "entry", "story") or len(found) > 1 and found[-1] in MARKS - {"header"}


def parse(page: str) -> Node:
    """The element tree of a page."""
    root = Node("#root")
    stack = [root]
    opened: Counter[str] = Counter()  # elements on the stack by name
    at, n = 0, len(page)

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def text(s: str) -> None:
        if s:
            stack[-1].parts.append(html.unescape(s) if "&" in s else s)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _TAG.match(page, lt)
        if not m:
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if not opened[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("article", "main", "body", "table", "td", "div", "section") and tag not in BLOCK:
                    break  # an inline end tag does not close blocks around it
            continue
        attrs = m[3] or m[6] or ""
        if tag in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in _CLOSED_BY and any(opened[x] for x in _CLOSED_BY[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSED_BY[tag]:
                    close(k)
                    break
                if stack[k].tag in _SCOPE[tag]:
                    break
        if tag == "body" and stack[-1].tag == "head":
            close(len(stack) - 1)
        if tag == "br":
            stack[-1].parts.append(" ")
            continue
        node = Node(tag, attrs)
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            if tag in ("textarea", "title"):
                node.parts.append(html.unescape(page[at : end.start() if end else n]))
            at = end.end() if end else n
        elif tag not in VOID and not attrs.endswith("/") or tag in ("p", "div", "span", "a", "b", "i", "li") and tag not in VOID:
            stack.append(node)
            opened[tag] += 1
    return root


def depth(root: Node) -> int:
    """Levels of a tree."""
    levels, row = 0, [root]
    while row:
        levels, row = levels + 1, [k for x in row for k in x.kids]
    return levels


def measure(node: Node) -> int:
    """Sets key (equal keys: equal content) and size (characters) below a node, own and own_size without its elements.

    Equal shapes have equal labels throughout, of `nodes` nodes.
    """
    size, key, own = 0, [node.tag], []
    for p in node.parts:
        if isinstance(p, str):
            s = " ".join(p.split())
            if s:
                own.append(s)
                key.append(s)
        else:
            size += measure(p)
            key.append(p.key)
    node.own, node.own_size = hash(tuple(own)), sum(map(len, own))
    node.key, node.size = hash(tuple(key)), size + node.own_size
    node.shape, node.nodes = hash((node.label, *(k.shape for k in node.kids))), 1 + sum(k.nodes for k in node.kids)
    return node.size


def _nodes(root: Node) -> Iterator[Node]:
    """A node and all below it."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(node.kids)


def align(a: Node, b: Node, pairs: list[tuple[Node, Node]], memo: dict[tuple[int, int], int] | None = None) -> int:
    """Simple tree matching: the most nodes that two trees share in order, under equal labels; `pairs` gets them.

    Among largest matches, lists of children take one with the most pairs of equal content.  Scores depend on labels
    alone, so `memo` keeps them by shapes.
    """
    if a.key is None or b.key is None:
        measure(a)
        measure(b)
    memo = {} if memo is None else memo
    if a.label != b.label:
        return 0
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        if x.kids and y.kids:
            stack.extend(_children(x.kids, y.kids, memo))
    return _score(a, b, memo)


def _score(a: Node, b: Node, memo: dict[tuple[int, int], int]) -> int:
    """The most nodes that two trees share in order."""
    if a.label != b.label:
        return 0
    if a.shape == b.shape:
        return a.nodes
    if not a.kids or not b.kids:
        return 1
    pair = a.shape, b.shape
    if pair not in memo:
        xs, ys = a.kids, b.kids
        lo, hi = _ends([x.shape for x in xs], [y.shape for y in ys])
        sure = sum(x.nodes for x in xs[:lo]) + sum(x.nodes for x in xs[len(xs) - hi :])
        for last in _rows(_weights(xs[lo : len(xs) - hi], ys[lo : len(ys) - hi], memo, 1), len(ys) - hi - lo):
            pass
        memo[pair] = 1 + sure + int(last[-1])
    return memo[pair]


def _ends(xs: list, ys: list) -> tuple[int, int]:
    """Lengths of the equal beginnings and, after these, of the equal ends of two lists."""
    n = min(len(xs), len(ys))
    lo = next((k for k in range(n) if xs[k] != ys[k]), n)
    hi = next((k for k in range(n - lo) if xs[-1 - k] != ys[-1 - k]), n - lo)
    return lo, hi


def _weights(xs: list[Node], ys: list[Node], memo: dict[tuple[int, int], int], unit: int) -> Callable[[int], np.ndarray | list[int]]:
    """Row i of the weights: `unit` for each node that xs[i] and ys[j] share, and one for equal content if units are larger."""
    kinds = {y.shape: y for y in ys}
    number = {shape: k for k, shape in enumerate(kinds)}
    column = [number[y.shape] for y in ys]
    scores: dict[int, list[int]] = {}
    small = len(ys) < 64
    at, keys = (column, [y.key for y in ys]) if small else (np.array(column), np.array([y.key for y in ys], np.int64))

    def row(i: int) -> np.ndarray | list[int]:
        x = xs[i]
        if x.shape not in scores:
            scores[x.shape] = [unit * _score(x, y, memo) for y in kinds.values()]
        s = scores[x.shape]
        if small:
            return [s[k] + (unit > 1 and s[k] > 0 and key == x.key) for k, key in zip(at, keys, strict=True)]
        w = np.array(s, np.int64)[at]
        return w + ((keys == x.key) & (w > 0)) if unit > 1 else w

    row.count = len(xs)
    return row


def _rows(weights: Callable, n: int, first: int = 0, end: int | None = None, start: np.ndarray | list[int] | None = None) -> Iterator:
    """Rows first, ..., end of the table of best totals; row i holds the best of the first i children of one list."""
    above = start if start is not None else [0] * (n + 1) if n < 64 else np.zeros(n + 1, np.int64)
    yield above
    for i in range(first, weights.count if end is None else end):
        w = weights(i)
        if n < 64:
            now, left = [0], 0
            for j in range(n):
                left = max(left, above[j + 1], above[j] + w[j])
                now.append(left)
        else:
            now = np.zeros(n + 1, np.int64)
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + w), out=now[1:])
        yield now
        above = now


def _children(xs: list[Node], ys: list[Node], memo: dict[tuple[int, int], int]) -> list[tuple[Node, Node]]:
    """Pairs of a best match of two lists of children, exact for any length.

    Only every r-th row of the table is kept, r the root of their number; the rows between are made again on the way back.
    """
    lo, hi = _ends([(x.shape, x.key) for x in xs], [(y.shape, y.key) for y in ys])
    got = [*zip(xs[:lo], ys[:lo], strict=True), *(zip(xs[-hi:], ys[-hi:], strict=True) if hi else ())]
    xs, ys = xs[lo : len(xs) - hi], ys[lo : len(ys) - hi]
    m, n = len(xs), len(ys)
    if not m or not n:
        return got
    weights = _weights(xs, ys, memo, min(m, n) + 1)
    step = math.isqrt(m) + 1
    kept = [row for i, row in enumerate(_rows(weights, n)) if i % step == 0]
    i, j = m, n
    while i and j:
        base = (i - 1) // step * step
        best = list(_rows(weights, n, base, i, kept[base // step]))
        while i > base and j:
            w = weights(i - 1)
            while j and best[i - base][j] != best[i - 1 - base][j - 1] + w[j - 1] and best[i - base][j] != best[i - 1 - base][j]:
                j -= 1
            if j and w[j - 1] and best[i - base][j] == best[i - 1 - base][j - 1] + w[j - 1]:
                got.append((xs[i - 1], ys[j - 1]))
                j -= 1
                i -= 1
            elif best[i - base][j] == best[i - 1 - base][j]:
                i -= 1
            elif j:
                j -= 1
    return got


def leaders(pages: list[Node], found: list[list[tuple[Node, Node]]]) -> list[int]:
    """One page for every family of near copies, the reference first: near copies say nothing about what is template.

    Copies agree on over half of the characters outside of the slots that stay the same throughout.  Over few pages no
    slot is known to stay the same, and all characters count.
    """
    slots: dict[int, int] = {}
    for node in _nodes(pages[0]):
        if node.own_size:
            slots[id(node)] = len(slots)
    value, chars = np.zeros((len(pages), len(slots)), np.int64), np.zeros((len(pages), len(slots)), np.int64)
    for k, pairs in enumerate([[(node, node) for node in _nodes(pages[0])], *found[1:]]):
        for r, x in pairs:
            if (j := slots.get(id(r))) is not None:
                value[k, j], chars[k, j] = x.own, x.own_size
    size = np.array([p.size for p in pages])
    if len(pages) > LEAST:
        varies = np.zeros(len(slots), bool)
        for j in range(len(slots)):
            there = value[chars[:, j] > 0, j]
            varies[j] = len(np.unique(there)) - 1 >= max(1, VARIES * len(there))
        size = size - chars[:, ~varies].sum(1)
        value, chars = value[:, varies], chars[:, varies]
    first: list[int] = []
    for k in range(len(pages)):
        same = ((value[first] == value[k]) * chars[k]).sum(1)
        if not (2 * same > size[k]).any():
            first.append(k)
    return first


def induce(pages: list[Node]) -> None:
    """Marks the template nodes of a group of one host's pages: those that stay the same while pages differ."""
    distinct = list({p.key: p for p in pages}.values())
    if len(distinct) < 2:
        return
    middle = len(distinct) // 2
    distinct.sort(key=lambda p: p.size)
    distinct.insert(0, distinct.pop(middle))
    reference = distinct[0]
    found: list[list[tuple[Node, Node]]] = [[]]
    memo: dict[tuple[int, int], int] = {}
    for page in distinct[1:]:
        found.append([])
        align(reference, page, found[-1], memo)
    matched = [pair for pairs in found for pair in pairs]
    first = leaders(distinct, found)
    least = LEAST if len(first) > LEAST else math.ceil(CONSTANT * (len(first) - 1))
    seen: dict[int, list[int]] = {}
    for k in first[1:]:
        for r, x in found[k]:
            c = seen.setdefault(id(r), [0, 0])
            c[0] += 1
            c[1] += r.key == x.key
    constant = {k for k, (n, same) in seen.items() if n >= least and same >= CONSTANT * n}
    for r, x in matched:
        if id(r) in constant:
            r.template = True
            x.template |= r.key == x.key and x.size > 0
    twins: dict[int, Node] = {p.key: p for p in distinct}
    for p in pages:
        if p is not (t := twins[p.key]):
            _copy_marks(t, p)


def _copy_marks(a: Node, b: Node) -> None:
    b.template = a.template
    for x, y in zip(a.kids, b.kids, strict=False):
        _copy_marks(x, y)


def _articles(node: Node, tags: tuple[str, ...], out: list[Node]) -> None:
    if node.dropped or node.tag == "header":
        return
    if node.tag in tags:
        out.append(node)
        return
    for k in node.kids:
        _articles(k, tags, out)


def content(root: Node) -> str:
    """The text of what is not template: a page's articles where it marks them, its main part, or all of it."""
    for tags in (("article",), ("main",), ()):
        tops: list[Node] = []
        if tags:
            _articles(root, tags, tops)
            tops = [t for t in tops if t.size]
        else:
            tops = [root]
        if tops:
            break
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        s = " ".join("".join(now).split())
        if s:
            blocks.append(s)
        now.clear()

    def walk(node: Node, inside: bool) -> None:
        # No share of links ends the descent: only declared or induced template is left out.
        if node.dropped or node.template and node.tag not in ("#root", "html", "body") or node.tag == "header" and not inside:
            return flush() if node.tag in BLOCK else None
        block = node.tag in BLOCK
        if block:
            flush()
        for p in node.parts:
            if isinstance(p, str):
                now.append(p)
            else:
                walk(p, inside)
        if block:
            flush()

    for t in tops:
        walk(t, bool(tags))
        flush()
    return "\n".join(blocks)


def extract_group(pages: list[str]) -> list[str]:
    """The texts of a group of one host's pages."""
    trees = [parse(p) for p in pages]
    # The functions below call themselves for every level of a tree, in frames that do not use the C stack.
    limit, deepest = sys.getrecursionlimit(), max(map(depth, trees), default=0)
    sys.setrecursionlimit(max(limit, 1000 + 8 * deepest))
    try:
        for t in trees:
            measure(t)
        induce(trees)
        return [content(t) for t in trees]
    finally:
        sys.setrecursionlimit(limit)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """id, url, text string, n_chars long for every page."""
    spark = pages.sparkSession
    small_batches(spark)
    kinds = dict(pages.dtypes)
    schema = f"i {kinds[id]}, u {kinds[url]}, text string, n_chars long, host string, h long, g long, common boolean"
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)", 1))
    src = pages.select(F.col(f"`{id}`").alias("i"), F.col(f"`{url}`").alias("u"), host.alias("host"), F.coalesce(F.col(f"`{page}`").cast("string"), F.lit("")).alias("p"))
    src = src.select("i", "u", "host", "p", F.xxhash64("p").alias("h"), F.xxhash64(F.lit(9), "p").alias("g"))
    one = ["host", "h", "g"]
    counts = stored(src.groupBy(*one).count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    # Pages with very many copies (at most 100,000 such pages) stand once in their group; their copies get the text by a join.
    most = max(4 * GROUP, total // 100_000)
    common = counts.where(F.col("count") > most).select(*one, F.ceil(F.col("count") / most).cast("int").alias("copies"))
    hosts = counts.groupBy("host").count()
    hot = hosts.where(F.col("count") > max(4 * GROUP, total // 1000)).select("host", F.ceil(F.col("count") / (2 * GROUP)).alias("parts"))

    def deal(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod("h", F.coalesce("parts", F.lit(1))))
        return rows.select("i", "u", "host", "salt", "h", "g", "common", "p")

    def extracted(rows: DataFrame) -> DataFrame:
        return rows.repartition("host", "salt").sortWithinPartitions("host", "salt", "h", "p").mapInArrow(run, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: list[pa.Field] = []
        held: list[tuple[str, list[tuple]]] = []  # distinct pages of a group, with the rows that have them
        size = [0]

        def out(n: int) -> Iterator[pa.RecordBatch]:
            group = held[:n]
            del held[:n]
            size[0] -= sum(len(page) for page, _ in group)
            texts = extract_group([page for page, _ in group])
            rows = [(r[0], r[1], text, len(text), r[2], r[4], r[5], r[6]) for text, (_, same) in zip(texts, group, strict=True) for r in same]
            at = 0
            while at < len(rows):
                end, chars = at, 0
                while end < len(rows) and (end == at or chars + rows[end][3] <= 4 << 20):
                    chars += rows[end][3]
                    end += 1
                types = [fields[0].type, fields[1].type, pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[at:end], strict=True), types, strict=True)], ["i", "u", "text", "n_chars", "host", "h", "g", "common"])
                at = end

        group = None
        for batch in batches:
            fields = fields or [batch.schema.field(k) for k in range(2)]
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and group != r[2:4]:
                    yield from out(len(held))
                group = r[2:4]
                if held and held[-1][0] == r[7]:
                    held[-1][1].append(r[:7])
                    continue
                # The last pages stay, so that no group of a host is left with too few to compare.
                rest = len(held) - LEAST - 1
                if rest >= GROUP or rest > LEAST and size[0] - sum(len(page) for page, _ in held[rest:]) > 8 << 20:
                    yield from out(rest)
                held.append((r[7], [r[:7]]))
                size[0] += len(r[7])
        if held:
            yield from out(len(held))

    result = [F.col("i").alias(id), F.col("u").alias(url), "text", "n_chars"]
    if common.isEmpty():
        return extracted(deal(src.withColumn("common", F.lit(False)))).select(*result)
    usual = src.join(F.broadcast(common), one, "left_anti").withColumn("common", F.lit(False))
    shared = src.join(F.broadcast(common), one, "left_semi")
    first = shared.groupBy(*one).agg(F.first("p").alias("p")).select(F.lit(None).cast(kinds[id]).alias("i"), F.lit(None).cast(kinds[url]).alias("u"), "host", "p", "h", "g", F.lit(True).alias("common"))
    dealt = deal(usual.unionByName(first))
    groups = deal(common.select(*one, F.lit(None).alias("i"), F.lit(None).alias("u"), F.lit(None).alias("p"), F.lit(True).alias("common"))).select("host", "salt").distinct()
    texts = extracted(dealt.join(F.broadcast(groups), ["host", "salt"], "left_semi").select(*dealt.columns)).where("common")
    texts = texts.join(F.broadcast(common), one).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(*one, "copy", "text", "n_chars")
    rows = src.join(F.broadcast(common), one).withColumn("copy", F.pmod(F.xxhash64("i", "u", F.monotonically_increasing_id()), F.col("copies")).cast("int"))
    joined = rows.select("i", "u", *one, "copy").join(texts, [*one, "copy"]).select(*result)
    return extracted(dealt).where("not common").select(*result).unionByName(joined)
