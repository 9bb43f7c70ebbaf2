"""Reports over matches by every set of columns, from summaries that are kept and merged.

``summarised`` has a row for each combination of the columns: counts, sums, a HyperLogLog sketch of the
records and a KLL sketch of the scores. Rows of several days, batches or regions are put together by ``cube``
without the matches themselves: exact figures are summed, sketches merged. Sketches have a fixed size,
so that neither a group's records nor its scores are ever held. The number of records is off
by about 1.04 / sqrt(2 ** log_size) in the mean, a quantile's rank by about 2.3 / k ** 0.9; groups with
few records or scores are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

LOG_SIZE, K = 12, 400


def summarised(matches: DataFrame, columns: Sequence[str], log_size: int = LOG_SIZE, k: int = K) -> DataFrame:
    """The columns with n_matches, n_scored, score_sum, records and scores (sketches). A match of two records counts once, and both records."""
    both = F.explode(F.array(F.struct(F.lit(1).alias("one"), F.col("id1").alias("id")), F.struct(F.lit(0).alias("one"), F.col("id2").alias("id"))))
    rows = matches.select(*columns, F.col("confidence_score").cast("double").alias("_score"), both.alias("_x"))
    score = F.when(F.col("_x.one") == 1, F.col("_score"))
    return rows.groupBy(*columns).agg(
        F.sum("_x.one").alias("n_matches"), F.count(score).alias("n_scored"), F.sum(score.cast("decimal(24,12)")).alias("score_sum"),
        F.hll_sketch_agg("_x.id", F.lit(log_size)).alias("records"), F.kll_sketch_agg_double(score, F.lit(k)).alias("scores"),
    )


def cube(summaries: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For every set of the columns: level (a bit for each column that is left out, the first one's highest), n_matches,
    n_scored, score_sum, mean_score, n_records (estimated), and the quartiles of the scores (estimated). A column that is left out is null."""
    merged = summaries.cube(*columns).agg(
        F.grouping_id().alias("level"), F.sum("n_matches").alias("n_matches"), F.sum("n_scored").alias("n_scored"), F.sum("score_sum").alias("score_sum"),
        F.hll_union_agg("records").alias("records"), F.kll_merge_agg_double("scores").alias("scores"),
    )
    quartiles = [F.when(F.col("n_scored") > 0, F.kll_sketch_get_quantile_double("scores", F.lit(p / 4))).alias(f"score_q{p}") for p in (1, 2, 3)]
    mean = F.when(F.col("n_scored") > 0, F.col("score_sum").cast("double") / F.col("n_scored"))
    return merged.select(*columns, "level", "n_matches", "n_scored", "score_sum", mean.alias("mean_score"), F.hll_sketch_estimate("records").alias("n_records"), *quartiles)
