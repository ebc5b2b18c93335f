"""Toxicity scores: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding: lower case, full-width and look-alike letters to Latin, digits and signs that stand for letters inside words.
A lexicon entry matches at the start of a word; a match inside an exception phrase does not count.  Entries and weights
are learned from labelled rows (document frequencies, log odds), and the score is a logistic function of the matched
weight, of that weight per word, and of length.

Defined results: null and empty texts match nothing and get the score of an empty text; repeated rows are scored
alike; rows with a null label are not learned from; with no labels at all the seed lexicon and fixed coefficients hold.
Only the id, the text and the label columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.llm.common import small_batches, stored

# Letters that look like Latin ones, and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u", "ꜱ": "s", "ᴜ": "u", "ᴏ": "o", "ᴛ": "t",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
SEEDS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
EXCEPTIONS = ("trash can", "trash bin", "pathetic fallacy", "clown fish", "clownfish", "circus clown", "stupid mistake of mine")

_FOLD = str.maketrans(LOOK_ALIKES | {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {chr(0xFF10 + k): chr(48 + k) for k in range(10)} | dict.fromkeys("​‌‍⁠﻿­", ""))
_SIGN = re.compile(r"(?<![0-9])[0134578@$]{1,3}(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$!|]{1,3}(?=[^\W\d_])|(?<=[^\W\d_])[013457]{1,2}(?![\w@$])")
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths, in characters, of the word starts considered as lexicon entries.
PREFIXES = (3, 4, 5, 6, 7, 8, 9, 10)


def fold(text: str) -> str:
    """The text as the lexicon sees it."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    return _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)


@dataclass(frozen=True)
class Model:
    """Lexicon entries with weights, exception phrases, and the coefficients of the logistic function."""

    lexicon: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEEDS, 4.0))
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, ...] = (-3.0, 1.0, 0.5, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for w, x in self.lexicon.items():
            a.add_word(w, (len(w), x))
        for w in self.exceptions:  # also where the same words are an entry
            a.add_word(w, (len(w), None))
        if len(a):
            a.make_automaton()
        return a

    def score(self, feature: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(feature)), feature]) @ np.array(self.coefficients)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def measure(text: str | None, automaton) -> tuple[float, float, float, int]:
    """Of one whole text: log of matched weight, log of weight per hundred words, log of words; and the matches."""
    if not text or not len(automaton):
        return 0.0, 0.0, math.log1p(len(text.split()) if text else 0), 0
    t = fold(text)
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(t):
        start = end - length + 1
        if weight is None:
            spared.append((start, end))
        elif not (start and t[start - 1].isalnum()):
            hits[start] = max(hits.get(start, 0.0), weight)  # of the entries that begin at one word, the heaviest
    for a, b in spared:
        for s in [s for s in hits if a <= s <= b]:
            del hits[s]
    total, n = sum(hits.values()), len(t.split())
    return math.log1p(total), math.log1p(100 * total / (n + 20)), math.log1p(n), len(hits)


def features(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """keep columns, f0, f1, f2 double and n_hits int of every text."""
    kinds = dict(docs.dtypes)
    names = [*keep, "f0", "f1", "f2", "n_hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for batch in batches:
            got = [measure(x.as_py(), a) for x in batch.column(len(keep))]
            cols = list(zip(*got, strict=True)) if got else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, pa.float64()) for c in cols[:3]), pa.array(cols[3], pa.int32())], names)

    small_batches(docs.sparkSession)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "f0 double", "f1 double", "f2 double", "n_hits int"])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def _term_counts(rows: DataFrame) -> DataFrame:
    """term, toxic, clean: the documents of each class in which a word starts with `term`, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: dict[int, Counter]) -> pa.RecordBatch:
            terms = list(counts[1].keys() | counts[0].keys())
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = set(_WORD.findall(fold(text.as_py() or "")))
                counts[int(y)].update({w[:k] for w in found for k in PREFIXES if len(w) >= k})
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield out(counts)
                    counts = {0: Counter(), 1: Counter()}
        yield out(counts)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(terms: list[tuple[str, int, int]], n_toxic: int, n_clean: int, most: int) -> dict[str, float]:
    """Entries by log odds: a longer start is kept only where it tells more than a kept shorter one."""
    odds = {t: math.log((a + 0.2) / (n_toxic + 1)) - math.log((b + 0.2) / (n_clean + 1)) for t, a, b in terms}
    chosen: dict[str, float] = {}
    for t in sorted(odds, key=lambda t: (len(t), t)):
        if not any(odds[t] < odds[p] + 1.0 for k in PREFIXES if (p := t[:k]) in chosen and k < len(t)):
            chosen[t] = odds[t]
    return dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:most])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Coefficients, intercept first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * w)
        w += np.clip(step, -5, 5)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, entries: int = 500, least: int = 6, least_odds: float = 2.0, exceptions: tuple[str, ...] = EXCEPTIONS, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from at most `sample` labelled rows, those whose ids hash lowest; `entries` bounds the lexicon.

    Entries need `least` toxic documents and log odds of `least_odds`.
    """
    picked = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).select(F.col(id).alias("__id"), F.col(label).cast("int").alias("__y"))
    picked = picked.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample)
    rows = stored(docs.select(F.col(id).alias("__id"), F.col(text).cast("string").alias("__text")).join(F.broadcast(picked), "__id"))
    counts = {r[0]: r[1] for r in rows.groupBy("__y").count().collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(exceptions=exceptions)
    bound = math.exp(least_odds) * (n_toxic + 1) / (n_clean + 1)
    terms = _term_counts(rows.select("__y", "__text")).where((F.col("toxic") >= least) & (F.col("toxic") + 0.2 > (F.col("clean") + 0.2) * bound))
    terms = terms.orderBy(F.desc(F.col("toxic") / (F.col("clean") + 1)), "term").limit(40 * entries).collect()
    lexicon = learn_lexicon([(r[0], r[1], r[2]) for r in terms], n_toxic, n_clean, entries)
    model = Model(lexicon or dict.fromkeys(SEEDS, 4.0), exceptions)
    got = features(rows, model, "__text", ["__id", "__y"]).orderBy(F.xxhash64("__id"), "__id", "__y").limit(2 * sample).toPandas()
    w = logistic(got[["f0", "f1", "f2"]].to_numpy(), got["__y"].to_numpy(float))
    return Model(model.lexicon, exceptions, tuple(float(v) for v in w))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns, score double in [0, 1], n_hits int."""
    got = features(docs, model, text, list(keep))
    z = sum((F.lit(c) * F.col(f"f{k}") for k, c in enumerate(model.coefficients[1:])), F.lit(model.coefficients[0]))
    return got.select(*keep, (1 / (1 + F.exp(-z))).alias("score"), "n_hits")
