"""Aggregations with stated conventions: three medians, zero filling, first and last wins, votes, quorums, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame, value: Column, low: Column | int, high: Column | int) -> DataFrame:
    """value, n of the values within bounds."""
    v = rows.select(value.alias("value")).where((F.col("value") >= low) & (F.col("value") <= high))
    return v.groupBy("value").agg(F.count("*").alias("n"))


def zero_filled(hist: DataFrame, width: int = 1) -> DataFrame:
    """bin, n from the first bin to the last, empty ones with 0; bins start at multiples of width."""
    binned = hist.groupBy((F.floor(F.col("value") / width) * width).cast("long").alias("bin")).agg(F.sum("n").alias("n"))
    ends = binned.agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    every = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.lit(width))).alias("bin"))
    return every.join(binned, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_median(hist: DataFrame) -> DataFrame:
    """median: the smallest value whose cumulative count reaches half of all."""
    total = hist.agg(F.sum("n").alias("total"))
    run = hist.withColumn("run", F.sum("n").over(Window.orderBy("value")))
    return run.crossJoin(F.broadcast(total)).where(F.col("run") * 2 >= F.col("total")).agg(F.min("value").alias("median"))


def ranked_pick(rows: DataFrame, by: list[str], value: str, at: Column, name: str) -> DataFrame:
    """by, name: the value at position at (0-based, from n) of each group in ascending order. The group is ranked by a
    window, which spills, and only one row of it goes on."""
    w = Window.partitionBy(*by)
    r = rows.where(F.col(value).isNotNull()).select(*by, value, (F.row_number().over(w.orderBy(value)) - 1).alias("pos"), F.count("*").over(w).alias("n"))
    return r.where(F.col("pos") == at).select(*by, F.col(value).alias(name))


def upper_medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """sorted[floor(n / 2)] of each group."""
    return ranked_pick(rows, by, value, F.floor(F.col("n") / 2), "median")


def sorted_percentiles(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """sorted[floor(share * (n - 1))] of each group."""
    return ranked_pick(rows, by, value, F.floor(F.lit(share) * (F.col("n") - 1)), "percentile")


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the first by order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def majority(rows: DataFrame, key: str, form: str, order: str) -> DataFrame:
    """key, form: the most frequent form; ties by the first seen."""
    c = rows.groupBy(key, form).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return c.groupBy(key).agg(F.max_by(form, F.struct("n", -F.col("seen"))).alias(form))


def mean_and_deviation(rows: DataFrame, value: Column) -> DataFrame:
    """mean and population deviation."""
    return rows.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def quorum(votes: DataFrame, key: str, voter: str) -> DataFrame:
    """key, voters of the keys that max(2, half of all voters) share; a voter has one vote for a key."""
    least = votes.agg(F.greatest(F.lit(2), F.ceil(F.countDistinct(voter) / 2)).alias("least"))
    c = votes.groupBy(key).agg(F.countDistinct(voter).alias("voters"))
    return c.crossJoin(F.broadcast(least)).where("voters >= least").select(key, "voters")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def top_used(rows: DataFrame, name: str, k: int) -> DataFrame:
    """name, n of the k most used; ties by name."""
    return rows.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def retrieval_metrics(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """recall_1, recall_3, recall_5, mrr; a missing rank is a miss."""
    hit = lambda k: F.avg(F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}")
    return ranks.agg(hit(1), hit(3), hit(5), F.avg(F.coalesce(1 / F.col(rank), F.lit(0.0))).alias("mrr"))


def threshold_sweep(answers: DataFrame, thresholds: list[float], penalty: float = 1.0) -> DataFrame:
    """threshold, answered, correct, utility = (correct - penalty * wrong) / n over answers (confidence, correct).

    One pass: each threshold is a pair of conditional sums."""
    n = answers.count()
    cols = []
    for i, t in enumerate(thresholds):
        said = F.col("confidence") >= t
        cols += [F.sum(said.cast("long")).alias(f"a{i}"), F.sum((said & F.col("correct")).cast("long")).alias(f"c{i}")]
    row = answers.agg(*cols)
    out = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"a{i}").alias("answered"), F.col(f"c{i}").alias("correct")) for i, t in enumerate(thresholds)]))
    s = row.select(out.alias("s")).select("s.*")
    return s.withColumn("utility", (F.col("correct") - penalty * (F.col("answered") - F.col("correct"))) / F.lit(max(1, n)))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of most utility; ties to the lower one."""
    return sweep.orderBy(F.desc("utility"), "threshold").limit(1)


def leave_one_out(answers: DataFrame, group: str, thresholds: list[float]) -> DataFrame:
    """group, threshold: the best threshold over all other groups. Sums per group and threshold, then totals less
    the group's own; nothing is scanned again for each group."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds]))
    g = answers.select(group, "confidence", "correct", t.alias("threshold")).groupBy(group, "threshold")
    said = F.col("confidence") >= F.col("threshold")
    g = g.agg(F.sum(F.when(said, F.when(F.col("correct"), 1).otherwise(-1)).otherwise(0)).alias("own"))
    rest = g.withColumn("rest", F.sum("own").over(Window.partitionBy("threshold")) - F.col("own"))
    return first_wins(rest, [group], [F.desc("rest"), F.asc("threshold")]).select(group, "threshold", "rest")
