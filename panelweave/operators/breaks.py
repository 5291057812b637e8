"""Level shifts in the longest consecutive run of each series.

Runs, scales and the choice by BIC are relational. The best split of a series
into k segments extends the best split of a prefix into k - 1, one step after
the other; a vectorised helper takes those steps for a series, and drops last
breaks that no mean of the last segment can make best any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.clean import evidence_band


def longest_run(points: DataFrame, key: str = "series", period: str = "period", value: str = "value") -> DataFrame:
    """Rows of each series' longest run of consecutive periods, the earliest of equals, numbered idx from 1."""
    known = points.filter(F.col(value).isNotNull())
    runs = known.withColumn("run", F.col(period) - F.row_number().over(Window.partitionBy(key).orderBy(period)))
    sized = runs.groupBy(key, "run").agg(F.count("*").alias("n"), F.min(period).alias("start"))
    best = sized.withColumn("o", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "start"))).filter("o = 1").select(key, "run", "n")
    return runs.join(best, [key, "run"]).select(key, period, value, "n", F.row_number().over(Window.partitionBy(key).orderBy(period)).alias("idx"))


def best_splits(t: np.ndarray, segment: int, breaks: int, stride: int = 64) -> Iterator[tuple[int, list[int], float]]:
    """(segments, breaks, squared error) of the best split of t into 1, 2, ... segments of at least so many values.

    Prefix sums make the squared error of any segment a difference of two
    entries. As functions of the mean of the last segment, the costs of two last
    breaks i < m differ by the same parabola whatever the end: m is better but
    for means within a radius of the mean of what lies between. A last break is
    dropped where its intervals have nothing in common, or lie within the widest
    one in which an earlier break is no worse: none is lost that is best, and
    equals go to the earliest. Few are left but within long runs of one value,
    which keep theirs. Memory is stride times the last breaks kept. More
    segments than make an error of 1e-12, the least that counts, are not tried.
    """
    n = len(t)
    s, q = np.append(0.0, np.cumsum(t)), np.append(0.0, np.cumsum(t * t))
    slack = 1e-9 * max(1.0, q[-1])

    def sse(i, j):
        total = s[j] - s[i]
        return np.maximum(0.0, q[j] - q[i] - total * total / np.maximum(j - i, 1))

    cost, lasts = np.full(n + 1, np.inf), []
    cost[segment:] = sse(0, np.arange(segment, n + 1))
    if n >= segment:
        yield 1, [], float(cost[n])
    for k in range(2, min(breaks + 1, n // segment) + 1):
        if cost[n] <= 1e-12:
            return
        longer, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        alive, (low, high, left, right) = np.zeros(0, int), np.zeros((4, 0))
        for at in range(k * segment, n + 1, stride):
            ends = np.arange(at, min(at + stride, n + 1))
            new = ends - segment
            alive, low, high = np.append(alive, new), np.append(low, np.full(len(new), -np.inf)), np.append(high, np.full(len(new), np.inf))
            i = alive[:, None]
            costs = np.where(i <= new, cost[i] + sse(i, ends), np.inf)
            best = np.round(costs, 12).argmin(axis=0)
            longer[ends], last[ends] = costs[best, np.arange(len(ends))], alive[best]
            between = np.maximum(new - i, 1)
            gain, middle = cost[new] - cost[i] - sse(i, new), (s[new] - s[i]) / between
            radius = np.sqrt(np.maximum(gain + slack, 0.0) / between)
            low = np.maximum(low, np.where(new > i, np.where(gain < -slack, np.inf, middle - radius), -np.inf).max(axis=1))
            high = np.minimum(high, np.where(new > i, middle + radius, np.inf).min(axis=1))
            inner = np.where((new > i) & (gain > 0), np.sqrt(np.maximum(gain, 0.0) / between), -1.0)
            widest = inner.argmax(axis=0), np.arange(len(new))
            left, right = np.append(left, middle[widest] - inner[widest]), np.append(right, middle[widest] + inner[widest])
            kept = (low <= high) & ~((low >= left) & (high <= right))
            alive, low, high, left, right = alive[kept], low[kept], high[kept], left[kept], right[kept]
        cost = longer
        lasts.append(last)
        cuts = [n]
        for of in reversed(lasts):
            cuts.append(int(of[cuts[-1]]))
        yield k, cuts[:0:-1], float(cost[n])


def mean_breaks(points: DataFrame, key: str = "series", period: str = "period", value: str = "value", least_run: int = 8, segment: int = 4, breaks: int = 3) -> DataFrame:
    """Per series with a long enough run: the number of segments, break positions and BICs.

    Values are scaled by the median of non-zero magnitudes (1 for an all-zero
    series) and pass through asinh. BIC = n ln(SSE / n) + (2 k - 1) ln n for k
    segments, SSE at least 1e-12; ties go to fewer segments, then to earlier
    last breaks.
    """
    run = longest_run(points, key, period, value).filter(F.col("n") >= least_run)
    scale = run.groupBy(key).agg(F.coalesce(F.median(F.when(F.col(value) != 0, F.abs(value))), F.lit(1.0)).alias("scale"))
    t = run.join(scale, key).withColumn("t", F.asinh(F.col(value) / F.col("scale")))

    @F.pandas_udf("array<struct<segments: int, b: array<bigint>, sse: double>>")
    def splits(values: pd.Series) -> pd.Series:
        return pd.Series([[{"segments": k, "b": b, "sse": e} for k, b, e in best_splits(np.asarray(v), segment, breaks)] for v in values], dtype=object)

    # the values of one series, in order, are one array
    packed = t.groupBy(key).agg(F.max("n").cast("long").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "t"))).alias("p"))
    n = F.col("n")
    union = packed.select(key, "n", F.explode(splits("p.t")).alias("e")).select(key, "n", "e.*")
    bic = n * F.log(F.greatest("sse", F.lit(1e-12)) / n) + (2 * F.col("segments") - 1) * F.log(n.cast("double"))
    scored = union.withColumn("bic", bic)
    plain = scored.filter("segments = 1").select(key, F.col("bic").alias("no_break_bic"))
    best = scored.withColumn("o", F.row_number().over(Window.partitionBy(key).orderBy(F.round("bic", 9), "segments", F.reverse("b")))).filter("o = 1")
    return best.join(plain, key).select(key, "n", "segments", F.col("b").alias("break_indices"), "bic", "no_break_bic", (F.col("no_break_bic") - F.col("bic")).alias("bic_improvement"))


def breakpoints(points: DataFrame, models: DataFrame, key: str = "series", period: str = "period", value: str = "value") -> DataFrame:
    """One row per break: the means before and after, their relative change, and the evidence."""
    run = longest_run(points, key, period, value)
    m = models.filter(F.size("break_indices") > 0)
    edges = F.concat(F.array(F.lit(0).cast("long")), F.col("break_indices"), F.array(F.col("n")))
    spans = m.select(key, "bic_improvement", F.posexplode(F.col("break_indices")).alias("k", "at"), edges.alias("e")).select(
        key, "bic_improvement", (F.col("k") + 1).alias("break_number"), "at", F.get("e", F.col("k")).alias("lo"), F.get("e", F.col("k") + 2).alias("hi")
    )
    rows = spans.join(run, key).filter((F.col("idx") > F.col("lo")) & (F.col("idx") <= F.col("hi")))
    left = F.col("idx") <= F.col("at")
    out = rows.groupBy(key, "break_number", "bic_improvement").agg(
        F.min(F.when(~left, F.col(period))).alias("break_period"), F.min(period).alias("pre_start"), F.max(F.when(left, F.col(period))).alias("pre_end"), F.max(period).alias("post_end"),
        F.avg(F.when(left, F.col(value))).alias("pre"), F.avg(F.when(~left, F.col(value))).alias("post"),
    )
    change = F.when(F.col("pre") != 0, (F.col("post") - F.col("pre")) / F.abs("pre"))
    return out.select(key, "break_number", "break_period", "pre_start", "pre_end", "post_end", F.round("pre", 4).alias("pre_mean"), F.round("post", 4).alias("post_mean"), F.round(change, 6).alias("relative_change"), F.round("bic_improvement", 6).alias("bic_improvement"), evidence_band(F.col("bic_improvement")).alias("evidence_strength"))
