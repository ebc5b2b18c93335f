"""The vectorised parts against brute force, without Spark."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tercet.llm import bpe, decontaminate, html_extract, near_duplicates, packing, quality, suffix_dedup, toxicity, va_search
from tercet.llm.common import utf8


def block(texts):
    return utf8(pa.array(texts, pa.string()))


def test_suffix_order_against_counting():
    rng = random.Random(5)
    for _ in range(150):
        w = rng.choice([8, 9, 16, 24, 200])
        letters = rng.choice([b"ab", b"a", b"abc\x00", bytes(range(256))])
        base = bytes(rng.choice(letters) for _ in range(3 * w + 20))
        parts = []
        for _ in range(rng.randint(1, 10)):
            i = rng.randint(0, w)
            p = bytearray(base[i : i + w + rng.randint(0, w)])
            if rng.random() < 0.6:
                p[rng.randrange(len(p))] = rng.choice(letters)
            parts.append(bytes(p))
        counts = np.array([rng.choice([1, 1, 2]) for _ in parts])
        seen = Counter()
        for p, n in zip(parts, counts, strict=True):
            for i in range(len(p) - w + 1):
                seen[p[i : i + w]] += int(n)
        want = [seen[p[i : i + w]] >= 2 for p in parts for i in range(len(p) - w + 1)]
        assert suffix_dedup.repeated_starts(parts, counts, w)[0].tolist() == want


def test_stretches_designate_by_content():
    rng = random.Random(1)
    passage = bytes(rng.randrange(97, 123) for _ in range(500))
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) + passage + b"x" * n for n in (0, 33, 250)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, a, more, h, f = suffix_dedup.stretches(np.frombuffer(b"".join(texts), np.uint8), off, 200)
    assert more.sum() + len(more) == sum(len(t) - 199 for t in texts)
    inner = set.intersection(*(set(zip(h[text == k].tolist(), f[text == k].tolist(), strict=True)) for k in range(3)))
    assert inner


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return bpe.vocabulary(tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_encoding_equals_the_library(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(1)
    letters = list("ab's stmdrevell  \n\t\r12é!?.'’ 　 中文٣Ⅷ\U0001f600𝟘é\x1c\x85")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", "a" * 3000, "'" * 500, " " * 700, "='= " * 300, " x'll've're's", None, "\n\n x", "<|endoftext|>"]
    data, off = block(texts)
    ids, before, at = vocabulary.encode(data, off)
    for i, t in enumerate(texts):
        assert ids[before[i] : before[i + 1]].tolist() == coder.encode_ordinary(t or "")
    assert vocabulary.decode(ids).tobytes() == data.tobytes()
    assert np.all(np.diff(at) > 0)


def test_packing_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(150):
        length = rng.choice([1, 2, 7, 16, 33, 64])
        sizes = np.array([rng.randint(1, length) for _ in range(rng.randint(0, 90))], int)
        bins = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        rooms: list[int] = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - s)
            else:
                rooms.append(length - s)
        assert sorted(length - sum(sizes[i] for i in b) for b in bins) == sorted(rooms)


def test_wu_manber_against_every_window():
    rng = random.Random(9)
    vocabulary = ["a", "b", "cc", "Dd", "é", "77"]
    for _ in range(60):
        items = [(str(k), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 6)))) for k in range(4)]
        texts = [" - ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(5)]
        data, off = block(texts)
        low, s, length, h, before = decontaminate.tokens(data, off)
        got = set()
        for p in decontaminate.compile_patterns(items, 3):
            for end, k in zip(*p.search(low, s, length, h, before), strict=True):
                row = int(np.searchsorted(before, end, "right") - 1)
                got |= {(row, int(end - before[row]), int(i)) for i in p.items[p.item_first[k] : p.item_first[k] + p.item_count[k]]}
        want = set()
        for row, t in enumerate(texts):
            words = [w.lower() for w in t.split(" - ")] if t else []
            for k, (_, item) in enumerate(items):
                own = item.lower().split()
                w = min(3, len(own))
                for i in range(len(own) - w + 1 if w else 0):
                    want |= {(row, j + w - 1, k) for j in range(len(words) - w + 1) if words[j : j + w] == own[i : i + w]}
        assert got == want


def test_signatures_keep_the_pigeonhole_promise():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (300, near_duplicates.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        k = rng.integers(0, near_duplicates.DISTANCE + 1)
        at = rng.choice(near_duplicates.SYMBOLS, k, replace=False)
        row[at] ^= 1
    d, meet = near_duplicates.first_meeting(a, b)
    ka, kb = near_duplicates.bucket_keys(a), near_duplicates.bucket_keys(b)
    assert (d <= near_duplicates.DISTANCE).all() and (ka == kb).any(1).all()
    assert (ka[np.arange(300), meet] == kb[np.arange(300), meet]).all()


def test_shingle_sets():
    key, size = near_duplicates.shingle_sets(*block(["A b c", "a  B\tc", "a", "", None, "b c a b c", "a b"]), 2)
    sets = np.split(key, np.cumsum(size)[:-1])
    assert size.tolist() == [2, 2, 1, 0, 0, 3, 1]
    assert sets[0].tolist() == sets[1].tolist() and len(np.intersect1d(sets[0], sets[5])) == 2
    assert len(np.intersect1d(sets[2], sets[6])) == 0


@pytest.mark.parametrize("cells", [256, 3])
@pytest.mark.parametrize("scale", [3, 60, 3e7, 2e8, 3e9])
def test_va_scans_are_exact(scale, cells, monkeypatch):
    """Bars from lower bounds, the vectors that they leave, and the exact results of those, against brute force."""
    monkeypatch.setattr(va_search, "CELLS", cells)
    rng = np.random.default_rng(4)
    q, v = np.floor(rng.normal(0, scale, (30, 8))), np.floor(rng.normal(0, scale, (200, 8)))
    v[:20] = v[20:40]
    q[:5] = v[:5]
    v[100:140] = v[100]
    at, id = np.arange(200), np.arange(200) // 2
    parts = [np.arange(0, 90), np.arange(90, 150), np.arange(150, 200)]
    file = [va_search.quantise(v[p]) for p in parts]
    assert all((low + c * w <= v[p]).all() and (v[p] <= low + c * w + w - 1).all() for p, (c, low, w) in zip(parts, file, strict=True))
    bars, best = va_search.Results(30, 20), va_search.Results(30, 20)
    for p, block in zip(parts, file, strict=True):
        va_search.lower_bounds(q, np.arange(30), block, at[p], id[p], bars)
    read = 0
    for p, (cell, low, width) in zip(parts, file, strict=True):
        need = va_search.reached(q, np.arange(30), (cell, low, width), at[p], id[p], bars.score[:, -1], bars.id[:, -1])
        read += need.sum()
        va_search.scan(q, np.arange(30), v[p][need], (cell[need], low, width), at[p][need], id[p][need], best)
    top = 2**63 - 1
    exact = [[max(2 - top, min(top, sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))) for b in v] for a in q]
    for i in range(30):
        want = sorted((-exact[i][j], j // 2) for j in range(200) if j != i)[:20]
        assert [(-int(s), int(k)) for s, k in zip(best.score[i], best.id[i], strict=True)] == want
    assert read <= 200


def test_sketches_never_overstate_the_distance():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 16, (400, near_duplicates.SYMBOLS)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.4, rng.integers(0, 1 << 16, a.shape), a).astype(np.uint16)
    d = near_duplicates.sketch_distance(near_duplicates.sketches(a), near_duplicates.sketches(b))
    assert (d == ((a ^ b) & 3 != 0).sum(1)).all() and (d <= (a != b).sum(1)).all()


def test_pages():
    page = "<html><body><div id=header><h1>Site</h1></div><div class='sidebar'>x</div><div class='post-content'><p>Hello <b>w</b>orld &amp; more<p>two\n  2</div><div class='cookie-notice'>c</div><section id='comments'><p>c1</p></section><form>f</form></body></html>"
    assert html_extract.extract_group([page, "", "<p", "a < b &lt c", "<script>var a='<p>x</p>'</script>ok"]) == ["Hello world & more\ntwo 2", "", "", "a < b < c", "ok"]
    article = "<nav>n</nav><article><header><h1>T</h1></header><p>x</p><aside>n</aside><div class='comments'>c</div></article><article class=comment>z</article><footer>f</footer>"
    assert html_extract.extract_group([article]) == ["T\nx"]


def test_wrapper_induction_finds_constant_slots():
    pages = [f"<body><div><span>Always the same line</span></div><div><p>Story {k} {'word ' * k}</p></div><div>Call us at any time today</div></body>" for k in range(4, 14)]
    assert html_extract.extract_group(pages) == [f"Story {k} {'word ' * k}".strip() for k in range(4, 14)]


def test_alignment_is_the_largest_match():
    a, b = (html_extract.parse(f"<ul>{x}</ul>") for x in ("<li>1</li><p>2</p><li>3</li>", "<p>2</p><li>3</li><li>4</li>"))
    pairs: list = []
    assert html_extract.align(a, b, pairs) == 4 and len(pairs) == 4


def test_folding_and_exceptions():
    assert toxicity.fold("Yоu 1D10T, st00pid ＭＯＲＯＮ 42 items") == "you idiot, stoopid moron 42 items"
    m = toxicity.Model({"clown": 3.0}, ("clown fish",))
    a = m.automaton()
    assert toxicity.measure("a clown", a)[3] == 1 and toxicity.measure("a clown fish", a)[3] == 0 and toxicity.measure("uptownclown", a)[3] == 0
    assert toxicity.measure(None, a) == (0.0, 0.0, 0.0, 0)


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    t = quality.fit(x[:2000], y[:2000])
    assert ((t.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    one = np.array([quality.Trees(*(getattr(t, k) for k in ("column", "threshold", "left", "value", "roots", "depth", "base"))).raw(r[None])[0] for r in x[:20]])
    assert np.allclose(one, t.raw(x[:20]))
    assert quality.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_statistics_of_odd_texts():
    s = quality.statistics(*block(["", None, "a", "x" * 50_000, "\n\n", "é é é"]))
    assert s.shape == (6, len(quality.STATISTICS)) and np.isfinite(s).all() and (s[0] == s[1]).all()


def test_trees_against_walking_each_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4)).round(1)
    t = quality.fit(x, (x[:, 1] + x[:, 3] > 0.2).astype(float), trees=12)

    def walk(row, node):
        c = int(t.column[node])
        return float(t.value[node]) if c < 0 else walk(row, int(t.left[node]) + int(row[c] > t.threshold[node]))

    want = [t.base + sum(walk(r, int(k)) for k in t.roots) for r in x[:100]]
    assert np.allclose(t.raw(x[:100]), want)


def test_lexicon_against_looking_at_every_word():
    rng = random.Random(4)
    lexicon, exceptions = {"ab": 2.0, "abc": 3.0, "c": 1.0, "dd": 0.5, "ba": 1.5}, ("ab cd", "dd", "c c")
    model = toxicity.Model(lexicon, exceptions)
    a = model.automaton()
    for _ in range(400):
        text = "".join(rng.choice("abcd  ") for _ in range(rng.randint(0, 30)))
        spared = {k for e in exceptions for i in range(len(text)) if text.startswith(e, i) for k in range(i, i + len(e))}
        hits = {i: max(w for t, w in lexicon.items() if text.startswith(t, i)) for i in range(len(text)) if i not in spared and (not i or not text[i - 1].isalnum()) and any(text.startswith(t, i) and t not in exceptions for t in lexicon)}
        f0, _, f2, n = toxicity.measure(text, a)
        assert n == len(hits) and np.isclose(np.expm1(f0), sum(hits.values())) and np.isclose(np.expm1(f2), len(text.split()))


def test_alignment_against_the_recurrence():
    """The score of simple tree matching, by its definition: a table over first children of both."""
    rng = random.Random(2)

    def tree(depth):
        kids = "".join(tree(depth - 1) for _ in range(rng.randint(0, 4))) if depth else ""
        tag = rng.choice(["div", "span", "b"])
        return f"<{tag}>{kids or rng.choice(['x', 'y'])}</{tag}>"

    def matched(a, b):
        if a.label != b.label:
            return 0
        m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids, 1):
            for j, y in enumerate(b.kids, 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + matched(x, y))
        return m[-1][-1] + 1

    for _ in range(80):
        a, b = (html_extract.parse(f"<section>{tree(3)}{tree(3)}</section>") for _ in "12")
        pairs: list = []
        score = html_extract.align(a, b, pairs)
        assert score == matched(a, b) == len(pairs) and all(x.label == y.label for x, y in pairs)


def test_pieces_of_any_length_designate_the_same_grams():
    """Pieces of one length and another designate the same grams."""
    rng = random.Random(7)
    passage = bytes(rng.randrange(97, 123) for _ in range(3000))
    a, b = (suffix_dedup.stretches(np.frombuffer(p, np.uint8), np.array([0, len(p)]), 200) for p in (passage, b"q" * 70_000 + passage + b"z" * 200_000))
    assert set(zip(a[3].tolist()[1:-1], a[4].tolist()[1:-1], strict=True)) <= set(zip(b[3].tolist(), b[4].tolist(), strict=True))
    with pytest.raises(ValueError):
        suffix_dedup.stretches(np.zeros((1 << 20) + 64, np.uint8), np.array([0, (1 << 20) + 64]), 200)
