"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Text is cut without a regex engine: each code point gets a class, the classes drive a small automaton, and the
automaton's transition functions (which compose associatively) are scanned in lanes to find where pieces start.
The pieces are looked up in a cache; unknown ones are merged, many at a time, by the lowest-ranked adjacent pair.

Defined results: null and empty texts have no tokens; every row gives one row; repeated rows give repeated rows;
extra columns, also of clashing names, are not read unless asked for in `keep`; texts of any length are whole.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.llm.common import map_text, ranges, slice_hashes

#: Pieces whose ids a worker keeps; a full cache is emptied, results do not depend on it.
CACHE_PIECES = 120_000
#: Pieces up to this many bytes are merged in matrices, longer ones one by one with a heap.
MATRIX_BYTES = 48
LANE = 512

# Symbols of the automaton; with RESET added for the first character of a text.
LETTER, NUMBER, OTHER, SHORT_SUFFIX, LONG_SUFFIX, WHITE, LAST_WHITE, LAST_SPACE, RESET = 0, 1, 2, 3, 4, 5, 6, 7, 8
# States: what the character just read belongs to; FRESH stands for a text's start and the end of a suffix like 's.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """For each symbol and state: the next state, and whether a piece starts at the character."""
    to, cut = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SHORT_SUFFIX: IN_OTHERS, LONG_SUFFIX: IN_OTHERS}
    suffix = {SHORT_SUFFIX: ONE_LEFT, LONG_SUFFIX: TWO_LEFT}
    for symbol in range(16):
        for state in range(8):
            s, kind = (FRESH, symbol - RESET) if symbol >= RESET else (state, symbol)
            if s in (ONE_LEFT, TWO_LEFT):
                to[symbol, state] = FRESH if s == ONE_LEFT else ONE_LEFT
            elif kind in run:
                goes_on = s in (run[kind], AFTER_SPACE)
                to[symbol, state] = run[kind] if goes_on else suffix.get(kind, run[kind])
                cut[symbol, state] = not goes_on
            elif kind == WHITE:
                to[symbol, state], cut[symbol, state] = IN_WHITE, s != IN_WHITE
            else:
                to[symbol, state], cut[symbol, state] = AFTER_SPACE if kind == LAST_SPACE else IN_WHITE, True
    return to, cut


TO, CUT = _automaton()


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE of every code point, by Unicode category and the White_Space property."""
    import tiktoken  # the class table of the library whose pieces ours must equal, asked once for all code points; no other will do

    single = {bytes([b]): b for b in range(256)}
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)

    def having(pattern: str) -> list[int]:
        coder = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        return [ord(c) for c in bytes(coder.encode_ordinary(text)).decode()]

    letters, numbers, white = having(r"\p{L}"), having(r"\p{N}"), having(r"\s")
    out = np.full(0x110000, OTHER, np.uint8)
    out[letters], out[numbers], out[white] = LETTER, NUMBER, WHITE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes and where each starts."""
    if not len(data) or int(data.max()) < 128:
        return data.astype(np.int32), np.arange(len(data))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(data)))
    lead = data[at].astype(np.int32)
    cp = np.where(size == 1, lead, lead & (0x7F >> np.minimum(size, 4)))
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        cp[more] = cp[more] << 6 | (data[at[more] + k] & 0x3F)
    return np.minimum(cp, 0x10FFFF), at


def symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's input: classes, refined by what follows in the same text. first: indices where texts start."""
    n = len(cp)
    begins = np.zeros(n + 4, bool)
    begins[first] = True
    begins[n:] = True
    near = np.concatenate([cp, np.zeros(3, cp.dtype)])
    kind = classes()[near]
    out = kind[:n].copy()
    white = np.flatnonzero(out == WHITE)
    white = white[~begins[white + 1] & (kind[white + 1] != WHITE)]
    out[white] = np.where(near[white] == 32, LAST_SPACE, LAST_WHITE)
    quote = np.flatnonzero(cp == 39)
    quote = quote[~begins[quote + 1]]
    a = near[quote + 1]
    out[quote[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT_SUFFIX
    b = np.where(begins[quote + 2], 0, near[quote + 2])
    long = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
    out[quote[long]] = LONG_SUFFIX
    out[first] += RESET
    return out


def scan(symbol: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character.

    Lanes of LANE characters compose their transition functions side by side, the lanes' functions are composed by a
    doubling prefix scan, and a second pass over the lanes, now with known states, reads the starts.
    """
    n = len(symbol)
    lanes = -(-n // LANE)
    grid = np.full(lanes * LANE, WHITE, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T).astype(np.intp) * 8
    to, cut = TO.ravel(), CUT.ravel()
    f = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    for row in grid:
        f = to[row[:, None] + f]
    step = 1
    while step < lanes:
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.intp), 1)
        step *= 2
    state = np.zeros(lanes, np.uint8)
    state[1:] = f[:-1, FRESH]
    out = np.empty((LANE, lanes), bool)
    for k, row in enumerate(grid):
        at = row + state
        out[k] = cut[at]
        state = to[at]
    return out.T.ravel()[:n]


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The byte positions where pieces start, over texts that lie one after another."""
    if not len(data):
        return np.zeros(0, np.int64)
    cp, at = code_points(data)
    rows = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
    return at[scan(symbols(cp, np.searchsorted(at, rows)))]


class Vocabulary:
    """The ranks of a file of base64 tokens and their numbers; `path` is a parameter, nothing is trained."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.none = size = max(self.ranks.values()) + 1
        self.token = [b""] * size
        for t, r in self.ranks.items():
            self.token[r] = t
        self.lengths = np.array([len(t) for t in self.token], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(self.token), np.uint8)
        self.keys = None
        self.clear()

    def _index_pairs(self) -> None:
        """The table of mergeable pairs; only encoding needs it."""
        found: dict[int, int] = {}
        for t, r in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = r
        self.bits = max(4, (4 * len(found)).bit_length())
        keys = np.full(1 << self.bits, -1, np.int64)
        values = np.full(1 << self.bits, self.none, np.int64)
        for key, r in found.items():
            at = int(self._slot(np.array([key], np.int64))[0])
            while keys[at] >= 0:
                at = (at + 1) & (len(keys) - 1)
            keys[at], values[at] = key, r
        self.keys, self.values, self.pairs = keys, values, found

    def clear(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's concatenation; self.none where there is none."""
        if self.keys is None:
            self._index_pairs()
        key = a << 32 | b
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.values[at], self.none)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            hit = open_[held == key[open_]]
            out[hit] = self.values[at[hit]]
            open_ = open_[(held != key[open_]) & (held >= 0)]
        return out

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of pieces of at most MATRIX_BYTES: each round merges one pair, the lowest and leftmost, in every piece."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        for lo in range(0, len(order), 4096):
            part = order[lo : lo + 4096]
            size = np.array([len(words[i]) for i in part])
            ids = np.full((len(part), int(size.max()) + 1), self.none, np.int64)
            ids[np.arange(ids.shape[1]) < size[:, None]] = self.byte[np.frombuffer(b"".join(words[i] for i in part), np.uint8)]
            live = np.arange(len(part))
            while len(live):
                now = ids[live]
                width = int(size[live].max())
                rank = self.merged(now[:, :width].ravel(), now[:, 1 : width + 1].ravel()).reshape(len(live), width)
                j = rank.argmin(1)
                best = rank[np.arange(len(live)), j]
                some = best < self.none
                live, j, best, now = live[some], j[some], best[some], now[some]
                col = np.arange(now.shape[1])
                now = np.take_along_axis(now, np.minimum(col + (col > j[:, None]), now.shape[1] - 1), 1)
                now[:, -1] = self.none
                now[np.arange(len(live)), j] = best
                ids[live] = now
                size[live] -= 1
            for k, i in enumerate(part):
                out[i] = ids[k, : size[k]].astype(np.uint32)
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """Token ids of one piece of any length, with a heap of adjacent pairs over a linked list."""
        import heapq

        if self.keys is None:
            self._index_pairs()
        ids = [int(self.byte[b]) for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < len(ids) and (r := self.pairs.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], j, ids[j]))

        for i in range(len(ids) - 1):
            push(i)
        while heap:
            r, i, a, j, b = heapq.heappop(heap)
            if ids[i] != a or after[i] != j or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in ids if x >= 0], np.uint32)

    def look_up(self, words: list[bytes]) -> list[int]:
        """Indices into self.ids, after merging the pieces that are not cached."""
        if len(self.cache) > CACHE_PIECES:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        whole = [w for w in new if w in self.ranks]
        short = [w for w in new if w not in self.ranks and len(w) <= MATRIX_BYTES]
        long = [w for w in new if w not in self.ranks and len(w) > MATRIX_BYTES]
        got = [np.array([self.ranks[w]], np.uint32) for w in whole] + self.merge_many(short) + [self.merge_long(w) for w in long]
        for w, ids in zip(whole + short + long, got, strict=True):
            self.cache[w] = len(self.ids)
            self.ids.append(ids)
        return [self.cache[w] for w in words]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all tokens, the number of tokens before each text, and each token's byte position in `data`."""
        s = pieces(data, offsets)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
        length = np.diff(np.append(s, len(data)))
        _, first, which = np.unique(slice_hashes(data, s, length), return_index=True, return_inverse=True)
        alike = length[first][which] == length
        at = ranges(s, length)
        other = ranges(s[first][which], np.where(alike, length, 0))
        if not alike.all() or (data[at] != data[other]).any():  # two pieces with one hash: tell them apart by their bytes
            raw = data.tobytes()
            seen: dict[bytes, int] = {}
            which = np.array([seen.setdefault(raw[a : a + k], len(seen)) for a, k in zip(s.tolist(), length.tolist(), strict=True)])
            words = list(seen)
        else:
            raw = data.tobytes()
            words = [raw[a : a + k] for a, k in zip(s[first].tolist(), length[first].tolist(), strict=True)]
        known = self.look_up(words)
        own = [self.ids[k] for k in known]
        count = np.array([len(x) for x in own], np.int64)
        flat = np.concatenate(own)
        start = np.cumsum(count) - count
        n = count[which]
        ids = flat[ranges(start[which], n)]
        before = np.concatenate([[0], np.cumsum(n)])
        size = self.lengths[ids]
        return ids, before[np.searchsorted(s, offsets)], np.cumsum(size) - size

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one token after another."""
        return self.pool[ranges(self.starts[ids], self.lengths[ids])]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary, with its cache, for each worker and file."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_offsets: bool = True) -> DataFrame:
    """keep columns, ids binary (little-endian unsigned 32-bit), n_tokens long and, if wanted, token_ends.

    token_ends binary: where each token ends in the text's UTF-8 bytes, as little-endian unsigned 32-bit integers.
    Pieces of different texts never merge. Special tokens are plain text.
    """
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids binary", "n_tokens long"] + ["token_ends binary"] * with_offsets)
    names = [*keep, "ids", "n_tokens"] + ["token_ends"] * with_offsets

    def each(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        v = vocabulary(path)
        ids, before, at = v.encode(data, off)
        raw = ids.astype("<u4").tobytes()
        out = [*batch.columns[: len(keep)], _cells(raw, before * 4), pa.array(np.diff(before))]
        if with_offsets:
            ends = at + v.lengths[ids] - np.repeat(off[:-1], np.diff(before))
            out.append(_cells(ends.astype("<u4").tobytes(), before * 4))
        return out

    return map_text(docs, list(keep), text, schema, each, names)


def _cells(raw: bytes, offsets: np.ndarray) -> pa.Array:
    """A binary column of consecutive parts of `raw`."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(raw)])


def decode(tokens: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "decoded") -> DataFrame:
    """keep columns and the bytes that the ids stand for; null ids give no bytes, an unknown id is an error."""
    kinds = dict(tokens.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` binary"])

    def each(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        v = vocabulary(path)
        raw = np.frombuffer(data.tobytes(), "<u4")
        size = np.concatenate([[0], np.cumsum(v.lengths[raw])])
        return [*batch.columns[: len(keep)], _cells(v.decode(raw).tobytes(), size[off // 4])]

    return map_text(tokens, list(keep), ids, schema, each, [*keep, out])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode() and then decode() give, as digests."""
    tokens = encode(docs, path, with_offsets=False)
    back = decode(tokens, path, keep=("doc_id", "n_tokens", "ids"))
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_by_library(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, ids binary and n_tokens long, as encode() gives them, by the installed tiktoken library.

    For callers whose own work is not the encoding; the defined results are those of encode().
    """
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids binary", "n_tokens long"])

    def each(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        coder = _library(path, pattern)
        got = [coder.encode_to_numpy(x or "", disallowed_special=()) for x in batch.column(len(keep)).to_pylist()]
        return [*batch.columns[: len(keep)], pa.array([x.astype("<u4").tobytes() for x in got], pa.binary()), pa.array([len(x) for x in got], pa.int64())]

    return map_text(docs, list(keep), text, schema, each, [*keep, "ids", "n_tokens"])


@lru_cache(2)
def _library(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
