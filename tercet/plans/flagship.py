"""The flagship query: which triplets show dislocations that revert before a stop-loss?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tercet.operators import events
from tercet.plans.frames import Frames, rounded


def reverting_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """triplet_id, method, n_events, success_count, failure_count, success_rate."""
    return rounded(events.label_summary(Frames(spark, sf_dir).labels))
