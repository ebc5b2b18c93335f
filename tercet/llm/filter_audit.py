"""Filter interaction audit: what each of several quality filters removes, alone, after others, and in every order.

From one pass over the documents come, for each part of the corpus, the joint-failure counts J[S] of all subsets S of the
filters: sums of products of the documents' 0/1 failure flags.  All else is inclusion-exclusion over the 2**k counts of a part,
in column arithmetic: survivors of a set of filters (Moebius inversion over its subsets), documents that fail one filter only
(inversion over the supersets), and the Shapley value of the game "documents removed by a set of filters", from its Harsanyi
dividends (-1)**(|S|+1) * J[S], each shared equally among the filters of S.  No document is looked at once an order is chosen.

Defined results: a null text is an empty one; a null part is the empty string; a null flag counts as passed; rows without an id
repeat nothing and have no labels; of equal texts those with the smallest id are no repeats, however many rows have that id; each
row counts as a document, repeated rows too; an id with several label rows has a label if any of them has it; an empty table has no
parts, hence no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.llm.common import stored

#: White space between words, as the contract has it.
SPACE = r"[\x20\x09-\x0D]+"
#: More filters than these would make a row of a part too wide (2**k counts a measure, k! orders).
MOST_FILTERS = 6


def text_filters(text: Column, least_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10) -> dict[str, Column]:
    """The failure conditions that a text alone decides: A too short, B too few distinct words, C too many capitals, D signs."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {
        "A": n < least_words,
        "B": F.lit(100) * distinct < F.lit(distinct_percent) * n,
        "C": F.lit(100) * capitals > F.lit(capital_percent) * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang", filters: dict[str, Column] | None = None, repeats: str = "E") -> DataFrame:
    """part, good, toxic and a 0/1 column for every filter, a row per document; `repeats` names the filter of repeated texts.

    Texts are read once.  From there on a document is its id, its part, its flags and a 256-bit digest of its text, of which the
    smallest id is found with partial sums in the tasks; the joins back are on rows of under 100 bytes, and can be split where a
    digest holds many of them.
    """
    asked = filters or text_filters(F.col(f"`{text}`"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rows = stored(docs.select(
        F.col(f"`{id}`").alias("__id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("__digest"),
        *(flag(c).alias(name) for name, c in asked.items()),
    ))
    first = rows.groupBy("__digest").agg(F.min("__id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    mark = lambda c: F.max((F.col(f"`{c}`") == 1).cast("int"))
    marks = labels.where(F.col(f"`{id}`").isNotNull()).groupBy(F.col(f"`{id}`").alias("__id")).agg(mark("quality").alias("good"), mark("toxic").alias("toxic"))
    got = rows.join(first, "__digest", "left").join(marks, "__id", "left")
    return got.select("part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), *asked, flag(F.col("__id") > F.col("__first")).alias(repeats))


def joint_failures(rows: DataFrame, names: Sequence[str], part: str = "part", measures: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """A row per part: arrays `joint` and `joint_<measure>` of 2**k sums of flag products; bit i of a place stands for names[i].

    The sum at 0 is the number of documents (or the sum of the measure).  One aggregation, partial in the tasks.
    """
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")

    def sums(weight: str) -> Column:
        product = lambda s: " * ".join([f"cast({weight} AS long)", *(f"`{n}`" for i, n in enumerate(names) if s >> i & 1)])
        return F.expr(f"array({', '.join(f'sum({product(s)})' for s in range(1 << len(names)))})")

    return rows.groupBy(part).agg(sums("1").alias("joint"), *(sums(f"`{m}`").alias(f"joint_{m}") for m in measures))


def _signed(joint: str, terms: list[tuple[int, int]]) -> str:
    """The sum of factor * joint[place], as SQL."""
    return " + ".join(f"{factor}L * {joint}[{place}]" for place, factor in terms)


def survivors(joint: str, k: int) -> Column:
    """Array: the documents that fail none of the filters of each subset; `joint` names the array of joint counts."""
    return F.expr(f"array({', '.join(_signed(joint, [(s, (-1) ** s.bit_count()) for s in range(1 << k) if s & p == s]) for p in range(1 << k))})")


def exactly(joint: str, k: int) -> Column:
    """Array: the documents that fail just the filters of each subset."""
    places = lambda p: [(s, (-1) ** (s.bit_count() - p.bit_count())) for s in range(1 << k) if s & p == p]
    return F.expr(f"array({', '.join(_signed(joint, places(p)) for p in range(1 << k))})")


def dividends(joint: str, k: int) -> Column:
    """Array: the Harsanyi dividend of each subset in the game of removed documents; the empty one has none."""
    return F.expr(f"array({', '.join(['0L', *(_signed(joint, [(s, (-1) ** (s.bit_count() + 1))]) for s in range(1, 1 << k))])})")


def shapley(joint: str, k: int) -> Column:
    """Array: for each filter, k! times its Shapley value: its removals summed over all orders.  Whole numbers."""
    shares = lambda i: [(s, (-1) ** (s.bit_count() + 1) * (factorial(k) // s.bit_count())) for s in range(1 << k) if s >> i & 1]
    return F.expr(f"array({', '.join(_signed(joint, shares(i)) for i in range(k))})")


def interactions(joint: DataFrame, names: Sequence[str], part: str = "part") -> DataFrame:
    """A row per part and subset of filters: subset, n_joint, n_exactly, n_survivors, dividend."""
    k, subsets = len(names), ["".join(n for i, n in enumerate(names) if s >> i & 1) for s in range(1 << len(names))]
    got = joint.select(part, F.array(*map(F.lit, subsets)).alias("subset"), F.col("joint").alias("n_joint"), exactly("joint", k).alias("n_exactly"), survivors("joint", k).alias("n_survivors"), dividends("joint", k).alias("dividend"))
    return got.select(part, F.expr("inline(arrays_zip(subset, n_joint, n_exactly, n_survivors, dividend))"))


def all_orders(joint: DataFrame, names: Sequence[str], part: str = "part") -> DataFrame:
    """A row per part, order of the filters and step in it, zeros too: part, filter_order, step (from 1), filter, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.  As many rows as parts times k! times k; documents play no part."""
    k, steps = len(names), []
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append(f"struct('{''.join(names[x] for x in order)}' AS filter_order, {step} AS step, '{names[i]}' AS filter, {i} AS i, {1 << i} AS own, {before} AS a, {before | 1 << i} AS b)")
            before |= 1 << i
    got = joint.select(
        part, "joint", survivors("joint", k).alias("left"), survivors("joint_good", k).alias("good"), survivors("joint_toxic", k).alias("toxic"),
        exactly("joint", k).alias("single"), shapley("joint", k).alias("shares"), F.expr(f"inline(array({', '.join(steps)}))"),
    )
    return got.selectExpr(
        part, "filter_order", "step", "filter", "left[b] AS kept", "left[a] - left[b] AS removed", "joint[own] - left[a] + left[b] AS redundant", "single[own] AS unique_fails",
        "good[a] - good[b] AS good_lost", "toxic[a] - toxic[b] AS toxic_lost", "shares[i] AS shapley",
    )


NAMES = ("A", "B", "C", "D", "E")


def audit(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """All orders of the five filters over `docs`; settings as in failures()."""
    return all_orders(joint_failures(failures(docs, labels, **settings), NAMES), NAMES)


SQL = r"""
WITH marks AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
told AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
flags AS (SELECT part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    (len(words) < 100)::int AS "A", (100 * len(list_distinct(words)) < 80 * len(words))::int AS "B",
    (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::int AS "C",
    regexp_matches(text, '[#$%&*|]')::int AS "D", coalesce(t.doc_id > first, false)::int AS "E"
    FROM told t LEFT JOIN marks m ON m.doc_id = t.doc_id),
long AS (SELECT part, good, toxic, "A" + 2 * "B" + 4 * "C" + 8 * "D" + 16 * "E" AS mask FROM flags),
patterns AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM long GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f) JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (SELECT filter_order, s.step::int AS step, bits[s.step] AS own, list_sum(bits[1:s.step]) - bits[s.step] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
counted AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (before + own)::int = 0 THEN n ELSE 0 END)::bigint AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & before::int = 0 THEN n ELSE 0 END)::bigint AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & before::int <> 0 THEN n ELSE 0 END)::bigint AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::bigint AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & before::int = 0 THEN good ELSE 0 END)::bigint AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & before::int = 0 THEN toxic ELSE 0 END)::bigint AS toxic_lost
    FROM patterns, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley FROM counted
"""
