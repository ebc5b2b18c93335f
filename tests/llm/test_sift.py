"""Documents that are left out before texts are shuffled: none that is wanted, most of the others."""

from pyspark.sql import functions as F

from tercet.llm import near_duplicates


def test_sift_keeps_what_is_wanted(spark, monkeypatch):
    src = spark.range(20_000).select(F.xxhash64("id").alias("row"), F.concat(F.lit("text "), "id").alias("t"), "id")
    for step in (1, 7, 1000):
        want = src.where(F.col("id") % step == 0).select("row")
        got = near_duplicates._sifted(src, want)
        n = want.count()
        assert got.join(want, "row", "left_semi").count() == n
        assert got.count() <= n + 20_000 / near_duplicates.SIFT * 1.3
    assert near_duplicates._sifted(src, want.limit(0)).count() == 0
    monkeypatch.setattr(near_duplicates, "reachable", lambda folder: False)
    assert near_duplicates._sifted(src, want).count() == 20_000


def test_texts_move_without_most_documents(spark, monkeypatch):
    """What is joined to the wanted rows, and so shuffled, is about what is wanted."""
    docs = spark.range(8_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"))
    rows = docs.where("doc_id < 80").select(F.col("doc_id").alias("node"), F.xxhash64("doc_id", "text").alias("row"))
    moved = []
    hint = type(docs).hint
    monkeypatch.setattr(type(docs), "hint", lambda self, *a: (moved.append(self.count()), hint(self, *a))[1])
    got = near_duplicates._texts(docs, rows, "doc_id", "text").collect()
    assert sorted((r.node, r.t) for r in got) == [(k, f"some words {k}") for k in range(80)]
    assert len(moved) == 1 and moved[0] < 800
