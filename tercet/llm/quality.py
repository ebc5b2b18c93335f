"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, vectorised over Arrow blocks; trees are grown on binned columns from gradient
histograms and flattened into arrays, which all rows traverse together, level by level.

Defined results: null and empty texts have the statistics of an empty text and are scored; repeated rows are scored
alike; rows with a null label are not learned from; without labels every score is 0.5.  Only the id, text and label
columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.llm.common import U64, map_text, slice_hashes, words

STATISTICS = (
    "log_bytes", "upper", "lower", "digit", "space", "newline", "multibyte", "sentence_end", "comma", "quote", "exclamation", "bar", "currency_or_markup", "bracket",
    "other_sign", "kinds_of_sign", "log_words", "word_length", "word_length_spread", "longest_word", "distinct_words", "commonest_word", "same_as_before", "same_as_two_before",
    "words_ending_in_sign", "log_lines", "line_length", "lines_ending_in_stop", "entropy",
)


def _sets(*groups: str) -> list[np.ndarray]:
    return [np.frombuffer(g.encode(), np.uint8) for g in groups]


_ENDS, _COMMA, _QUOTE, _SHOUT, _BAR, _MARK, _BRACKET = _sets(".?;:", ",", "'\"`", "!", "|", "#$%&*+=<>@^_~\\/", "()[]{}")
_SIGN = np.zeros(256, bool)
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text of a block."""
    n, size = len(off) - 1, np.diff(off).astype(float)
    row = np.repeat(np.arange(n), np.diff(off))
    h = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    share = lambda cols, of: h[:, cols].sum(1) / np.maximum(of, 1)
    out = np.zeros((n, len(STATISTICS)))
    put = dict(zip(STATISTICS, out.T, strict=True))
    put["log_bytes"][:] = np.log1p(size)
    for name, cols in (("upper", np.arange(65, 91)), ("lower", np.arange(97, 123)), ("digit", np.arange(48, 58)), ("space", [32]), ("newline", [10]), ("multibyte", np.arange(128, 256)), ("sentence_end", _ENDS), ("comma", _COMMA), ("quote", _QUOTE), ("exclamation", _SHOUT), ("bar", _BAR), ("currency_or_markup", _MARK), ("bracket", _BRACKET)):
        put[name][:] = share(cols, size)
    put["other_sign"][:] = share(np.flatnonzero(_SIGN), size)
    put["kinds_of_sign"][:] = (h[:, _SIGN] > 0).sum(1)
    p = h / np.maximum(size, 1)[:, None]
    put["entropy"][:] = -(p * np.log2(np.maximum(p, 1e-12))).sum(1)
    lines = h[:, 10] + (size > 0)
    put["log_lines"][:], put["line_length"][:] = np.log1p(lines), np.log1p(size / np.maximum(lines, 1))
    s, length, before = words(data, off, _IS_WORD)
    count = np.diff(before).astype(float)
    some = np.maximum(count, 1)
    of = np.repeat(np.arange(n), np.diff(before))
    mean = lambda x: np.bincount(of, x, n) / some
    put["log_words"][:], put["word_length"][:] = np.log1p(count), mean(length)
    put["word_length_spread"][:] = np.sqrt(np.maximum(mean(length.astype(float) ** 2) - mean(length) ** 2, 0))
    if not len(s):
        return out
    np.maximum.at(put["longest_word"], of, np.log1p(length))
    hashes = slice_hashes(data, s, length)
    key = hashes ^ (of.astype(U64) * U64(0x9E3779B97F4A7C15))
    u, first, times = np.unique(key, return_index=True, return_counts=True)
    put["distinct_words"][:] = np.bincount(of[first], minlength=n) / some
    most = np.zeros(n)
    np.maximum.at(most, of[first], times)
    put["commonest_word"][:] = most / some
    for name, k in (("same_as_before", 1), ("same_as_two_before", 2)):
        put[name][:] = mean(np.concatenate([np.zeros(k, bool), (hashes[k:] == hashes[:-k]) & (of[k:] == of[:-k])])[: len(of)])
    put["words_ending_in_sign"][:] = mean(_SIGN[data[s + length - 1]])
    stop = np.flatnonzero(data[:-1] == 46)
    stop = stop[(data[stop + 1] == 10) & (row[stop] == row[stop + 1])]
    put["lines_ending_in_stop"][:] = np.bincount(row[stop], minlength=n) / np.maximum(lines, 1)
    return out


@dataclass(frozen=True)
class Trees:
    """Trees flattened into arrays: column (-1 in leaves), threshold, left child (the right one follows), value."""

    column: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds; all rows and trees step down one level at a time."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            c = self.column[node]
            node = np.where(c < 0, node, self.left[node] + (x[rows, np.maximum(c, 0)] > self.threshold[node]))
        return self.base + self.value[node].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 20) -> Trees:
    """Gradient-boosted trees for log loss, split on histograms of at most `bins` quantile bins a column."""
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        base = float(np.clip(np.log(max(p, 1e-3) / max(1 - p, 1e-3)), -3, 3)) if len(y) else 0.0
        return Trees(*(np.zeros(0, t) for t in (int, float, int, float, int)), 0, base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    width = max(len(e) for e in edges) + 1
    base = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), base)
    column, threshold, left, value, roots = [], [], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, w = p - y, p * (1 - p)
        roots.append(len(column))
        column.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
        node, level = np.full(len(y), roots[-1]), [roots[-1]]
        for d in range(depth + 1):
            place = np.full(len(column), -1)
            place[level] = np.arange(len(level))
            own = place[node]
            live = own >= 0
            k = len(level)
            sums = np.stack([np.bincount(own[live], v[live], k) for v in (g, w)])
            for j, m in enumerate(level):
                value[m] = float(-rate * sums[0, j] / (sums[1, j] + l2))
            if d == depth:
                break
            best = np.zeros(k), np.full(k, -1), np.zeros(k, int)
            for c in range(x.shape[1]):
                at = own[live] * width + binned[live, c]
                G, H, N = (np.bincount(at, v, k * width).reshape(k, width).cumsum(1) for v in (g[live], w[live], np.ones(live.sum())))
                gain = G**2 / (H + l2) + (sums[0][:, None] - G) ** 2 / (sums[1][:, None] - H + l2) - (sums[0] ** 2 / (sums[1] + l2))[:, None]
                gain[(N < least) | (N[:, -1:] - N < least)] = 0
                gain[:, len(edges[c]) :] = 0
                top = gain.argmax(1)
                better = gain[np.arange(k), top] > best[0] + 1e-9
                best[0][better], best[1][better], best[2][better] = gain[np.arange(k), top][better], c, top[better]
            nxt = []
            for j, m in enumerate(level):
                if (c := int(best[1][j])) < 0:
                    continue
                column[m], threshold[m], left[m] = c, float(edges[c][best[2][j]]), len(column)
                for _ in range(2):
                    nxt.append(len(column))
                    column.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
                mine = node == m
                node[mine] = left[m] + (binned[mine, c] > best[2][j])
            level = nxt
            if not level:
                break
        z += np.array(value)[node]
    return Trees(*(np.array(v) for v in (column, threshold, left, value, roots)), depth, base)


def measured(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep columns and x: the STATISTICS of every text."""
    kinds = dict(docs.dtypes)

    def each(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        x = statistics(data, off)
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        return [*batch.columns[: len(keep)], cells]

    return map_text(docs, keep, text, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "x array<double>"]), each, [*keep, "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id: str = "doc_id", text: str = "text", label: str = "quality", **settings: float) -> Trees:
    """Trees from at most `sample` labelled rows, those whose ids hash lowest; settings as in fit()."""
    picked = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).select(F.col(id).alias("__id"), F.col(label).cast("int").alias("__y"))
    picked = picked.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample)
    rows = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(picked), "__id")
    got = measured(rows, ["__id", "__y"], "__text").orderBy(F.xxhash64("__id"), "__id", "__y").limit(2 * sample).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(STATISTICS))
    return fit(x, got["__y"].to_numpy(float), **settings)


def score(docs: DataFrame, model: Trees, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns and score double in [0, 1]."""
    kinds = dict(docs.dtypes)

    def each(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        return [*batch.columns[: len(keep)], pa.array(model.score(statistics(data, off)))]

    return map_text(docs, list(keep), text, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]), each, [*keep, "score"])
