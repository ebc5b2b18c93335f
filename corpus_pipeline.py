"""A training corpus from `documents`: good, once each, without repeated passages or benchmark text, as token ids.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written before the next
one reads it.  All but the last return the columns of `documents`.

Defined results: null and empty texts go where the classifier rejects them, and else pass all stages (no tokens, digests of
nothing); ties between near duplicates go to the smaller id, then to the smaller hash of id and text; of repeated rows
one stays; rows without an id are near duplicates like others, and give way to rows with one; an empty table gives no rows;
further columns of `documents` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tercet.llm import bpe, decontaminate, near_duplicates, quality, suffix_dedup
from tercet.llm.common import stored, table
from tercet.llm.queries import CUT, held_out, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out(4, 2)))
    return quality.score(docs, model, keep=COLUMNS).where(F.col("score") >= CUT).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates by five-word shingles, that of the smallest id; texts without words stay."""
    return near_duplicates.representatives(docs.select(*COLUMNS)).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what strings of 200 bytes that occur elsewhere too cover; n_chars follows."""
    kept = suffix_dedup.remove(docs, keep=("doc_id", "lang", "source"))
    texts = suffix_dedup.as_text(kept, ["doc_id", "lang", "source"])
    return texts.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where("n_hit = 0").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of them and of the bytes that they decode to."""
    tokens = bpe.encode(docs, tokenizer_path(), with_offsets=False)
    back = bpe.decode(tokens, tokenizer_path(), keep=("doc_id", "n_tokens", "ids"))
    return back.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: The classifier is no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
