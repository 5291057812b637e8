"""Descriptive, rank and robustness statistics over long panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions.clean import lineage, stability_band
from panelweave.operators.panel import money
from panelweave.operators.ranges import in_ranges, middle_values, midpoint, placed, value_counts
from panelweave.plans.storage import durable


def describe(long: DataFrame) -> DataFrame:
    """Per metric: counts, coverage, mean, median, sample deviation, quartiles (linear interpolation), range."""
    v, known = F.col("value"), F.col("value").isNotNull()
    return long.groupBy("metric").agg(
        F.count("*").alias("panel_rows"),
        F.count(v).alias("observed_count"),
        F.count_if(~known).alias("missing_count"),
        F.round(F.count_if(~known) / F.count("*"), 6).alias("missing_rate"),
        F.countDistinct(F.when(known, F.col("entity"))).alias("entities_with_data"),
        F.countDistinct(F.when(known, F.col("period"))).alias("periods_with_data"),
        F.round(money(v) / F.count(v), 4).alias("mean"),
        F.round(F.median(v), 4).alias("median"),
        F.round(F.stddev_samp(v), 2).alias("std_dev"),
        F.round(F.percentile(v, 0.25), 4).alias("p25"),
        F.round(F.percentile(v, 0.75), 4).alias("p75"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.count_if(v == 0).alias("zero_count"),
        F.count_if(v < 0).alias("negative_count"),
    )


def period_trends(long: DataFrame, full_rows: int | None = None) -> DataFrame:
    """Per metric and period: totals, means, medians and what the source covers.

    long is balanced; with full_rows and a column row_count, a period is
    complete when some entity has that many rows.
    """
    v, known = F.col("value"), F.col("value").isNotNull()
    span = Window.partitionBy("metric")
    cells = long.groupBy("metric", "period").agg(
        F.count(v).alias("observed_entities"),
        money(v).alias("total_value"),
        F.round(money(v) / F.count(v), 4).alias("mean_value"),
        F.round(F.median(v), 4).alias("median_value"),
        *([F.max("row_count").alias("most_rows")] if full_rows else []),
    )
    seen = F.when(F.col("observed_entities") > 0, F.col("period"))
    cells = cells.withColumns({"first_observed": F.min(seen).over(span), "last_observed": F.max(seen).over(span)})
    some = F.col("observed_entities") > 0
    status = F.when(some, "observed").when(F.col("period").between(F.col("first_observed"), F.col("last_observed")), "no_observations_within_source_span").otherwise("outside_source_coverage")
    complete = F.when(~some, F.lit(False))
    if full_rows:
        full = F.col("most_rows") >= full_rows
        status = F.when(some & full, "observed_full_period").when(some, "observed_partial_period").otherwise(status)
        complete = F.when(some, full).otherwise(F.lit(False))
    return cells.withColumns({"period_complete": complete, "coverage_status": status}).drop("most_rows")


def entity_summary(long: DataFrame) -> DataFrame:
    """Per metric and entity with data: totals, means, medians, span, and the rank by total (ties by name)."""
    known = long.filter(F.col("value").isNotNull())
    out = known.groupBy("metric", "entity").agg(
        F.count("*").alias("observed_periods"),
        F.min("period").alias("first_observed"),
        F.max("period").alias("last_observed"),
        money("value").alias("total_value"),
        F.round(money("value") / F.count("*"), 4).alias("period_mean"),
        F.round(F.median("value"), 4).alias("period_median"),
    )
    return out.withColumn("rank_within_metric", F.row_number().over(Window.partitionBy("metric").orderBy(F.col("total_value").desc(), "entity")))


def average_ranks(rows: DataFrame, within: list[str], value: str) -> DataFrame:
    """rows with average_rank: the rank of value from 1 within its group, ties at their average; NULL without a value."""
    ranks = placed(value_counts(rows, within, value), within, value)
    return rows.join(ranks.select(*within, value, (F.col("below") + (F.col("n") + 1) / 2).alias("average_rank")), [*within, value], "left")


def metric_pairs(long: DataFrame) -> DataFrame:
    """(left_metric, right_metric, entity, period, x, y): pairwise complete cells."""
    known = long.filter(F.col("value").isNotNull()).select("metric", "entity", "period", "value")
    l, r = known.alias("l"), known.alias("r")
    return l.join(r, (F.col("l.entity") == F.col("r.entity")) & (F.col("l.period") == F.col("r.period")) & (F.col("l.metric") < F.col("r.metric"))).select(
        F.col("l.metric").alias("left_metric"), F.col("r.metric").alias("right_metric"), "l.entity", "l.period", F.col("l.value").alias("x"), F.col("r.value").alias("y")
    )


def correlation_points(long: DataFrame, least_cells: int = 15, least_entities: int = 8, least_shared: int = 2) -> DataFrame:
    """Points of both scopes: single cells, and entity totals over shared periods."""
    pairs = metric_pairs(long)
    keys = ["left_metric", "right_metric"]
    cells = pairs.select(F.lit("entity_period_overlap").alias("scope"), *keys, F.concat_ws("|", "entity", "period").alias("point"), "x", "y", F.lit(1).cast("long").alias("shared"))
    totals = pairs.groupBy(*keys, "entity").agg(money("x").alias("x"), money("y").alias("y"), F.count("*").alias("shared")).filter(F.col("shared") >= least_shared)
    totals = totals.select(F.lit("entity_common_period_total").alias("scope"), *keys, F.col("entity").alias("point"), "x", "y", "shared")
    points = cells.unionByName(totals)
    enough = points.groupBy("scope", *keys).agg(F.count("*").alias("n"))
    enough = enough.filter(F.col("n") >= F.when(F.col("scope") == "entity_period_overlap", least_cells).otherwise(least_entities))
    return points.join(enough.select("scope", *keys), ["scope", *keys], "left_semi")


def ranked_cells(points: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct points (keys, x, y) with how often they occur (w), their shared cells, and per side the points below, beside and above.

    Written, since both correlations read it.
    """
    cells = durable(points.groupBy(*keys, "x", "y").agg(F.count("*").alias("w"), F.sum("shared").alias("shared")), "cells")
    side = lambda v: placed(cells.groupBy(*keys, v).agg(F.sum("w").alias("n")), keys, v).select(*keys, v, *(F.col(c).alias(f"{c}_{v}") for c in ("below", "n", "above")))
    return durable(cells.join(side("x"), [*keys, "x"]).join(side("y"), [*keys, "y"]), "ranked-cells")


def _spearman(ranked: DataFrame, keys: list[str]) -> DataFrame:
    # twice an average rank less twice the mean of all ranks is the points below less the points above
    dx, dy = ((F.col(f"below_{v}") - F.col(f"above_{v}")).cast("double") for v in "xy")
    total = lambda c: F.sum(F.col("w") * c)
    rho = F.try_divide(total(dx * dy), F.sqrt(total(dx * dx)) * F.sqrt(total(dy * dy)))
    return ranked.groupBy(*keys).agg(F.sum("w").alias("paired_observations"), F.sum("shared").alias("shared_cells"), F.round(rho, 6).alias("spearman_rho"))


def spearman(points: DataFrame, keys: list[str]) -> DataFrame:
    """Spearman's rho: Pearson's correlation of average ranks; NULL where a side does not vary."""
    return _spearman(ranked_cells(points, keys), keys)


def _kendall(ranked: DataFrame, keys: list[str]) -> DataFrame:
    size = F.col("below_y") + F.col("n_y") + F.col("above_y")
    levels = ranked.select(*keys, "below_x", "below_y", "w", F.explode(F.sequence(F.lit(0), F.length(F.bin(size)) - 1)).alias("bit"))
    levels = levels.select(*keys, "below_x", "w", "bit", F.expr("shiftright(below_y, bit + 1)").alias("higher"), (F.expr("shiftright(below_y, bit)") % 2 == 1).alias("is_set"))
    group = [*keys, "bit", "higher"]
    count = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0))
    steps = levels.groupBy(*group, "below_x").agg(count(F.col("is_set")).alias("n"), count(~F.col("is_set")).alias("rest"))
    discordant = placed(steps, group, "below_x").groupBy(*keys).agg(F.sum(F.col("rest") * F.col("below")).cast("double").alias("d"))

    # a point is beside n - 1 others of its value, and each pair is met twice
    pairs = lambda n: (F.sum(F.col("w") * (n - 1)) / 2)
    counts = ranked.groupBy(*keys).agg(pairs(size).alias("all_pairs"), pairs(F.col("n_x")).alias("x_pairs"), pairs(F.col("n_y")).alias("y_pairs"), pairs(F.col("w")).alias("both_pairs")).join(discordant, keys)
    # without ties in x (in y): what tau-b divides by
    free_x, free_y = F.col("all_pairs") - F.col("x_pairs"), F.col("all_pairs") - F.col("y_pairs")
    c = F.col("all_pairs") - F.col("x_pairs") - F.col("y_pairs") + F.col("both_pairs") - F.col("d")
    scale = F.sqrt(free_x * free_y)
    return counts.select(*keys, F.round(F.when(scale > 0, (c - F.col("d")) / scale), 6).alias("kendall_tau_b"))


def kendall(points: DataFrame, keys: list[str]) -> DataFrame:
    """Kendall's tau-b over pairs of points, from counts alone: n points make n log n rows, no pairs.

    Two ranks of y differ first in some bit. Among points that agree in all
    higher bits, one with the bit and a smaller x is discordant with one
    without it, so running counts over x, made in ranges, give the discordant
    pairs of each bit. Pairs tied in x or y come from group sizes; concordant
    ones are left.
    """
    return _kendall(ranked_cells(points, keys), keys)


def correlations(long: DataFrame) -> DataFrame:
    """Rank correlations of every metric pair in both scopes."""
    keys = ["scope", "left_metric", "right_metric"]
    ranked = ranked_cells(correlation_points(long), keys)
    return _spearman(ranked, keys).join(_kendall(ranked, keys), keys, "left")


def robustness(baseline: DataFrame, robust: DataFrame) -> DataFrame:
    """How correlations move without outliers."""
    keys = ["scope", "left_metric", "right_metric"]
    r = robust.select(*keys, F.col("paired_observations").alias("robust_n"), F.col("spearman_rho").alias("robust_spearman"), F.col("kendall_tau_b").alias("robust_kendall"))
    delta = F.round(F.col("robust_spearman") - F.col("spearman_rho"), 6)
    return baseline.join(r, keys).select(
        *keys, lineage(F.col("left_metric"), F.col("right_metric")).alias("lineage_classification"), F.col("paired_observations").alias("baseline_n"), "robust_n",
        F.col("spearman_rho").alias("baseline_spearman"), "robust_spearman", delta.alias("delta_spearman"), F.col("kendall_tau_b").alias("baseline_kendall"), "robust_kendall",
        F.round(F.col("robust_kendall") - F.col("kendall_tau_b"), 6).alias("delta_kendall"), stability_band(delta).alias("stability"),
    )


def outliers(records: DataFrame, group: list[str], value: str = "amount", least: int = 10, cut: float = 3.5) -> DataFrame:
    """records with method, robust_z, group_count and group_median where a value is a candidate outlier.

    z = 0.6745 * (log10 x - median) / MAD within the group, where it has
    ``least`` positive values and MAD > 0; values of zero or less get their own
    method. Nothing is deleted.
    """
    x = F.col(value)
    counts = in_ranges(value_counts(records.filter(x > 0), group, value), group, value)
    # the logarithm keeps the order, so the middle values give both medians
    centre = middle_values(counts, group, value).select(
        *group, F.col("n").alias("group_count"), midpoint(F.log10("low"), F.log10("high")).alias("centre"), midpoint(F.col("low"), F.col("high")).alias("group_median")
    )
    apart = counts.join(centre, group).groupBy(*group, F.abs(F.log10(x) - F.col("centre")).alias("apart")).agg(F.sum("n").alias("n"))
    spread = middle_values(apart, group, "apart").select(*group, midpoint(F.col("low"), F.col("high")).alias("mad"))
    stats = centre.join(spread, group)
    z = F.round(0.6745 * (F.log10(x) - F.col("centre")) / F.col("mad"), 4)
    judged = records.join(stats, group, "left").withColumn("robust_z", F.when((x > 0) & (F.col("group_count") >= least) & (F.col("mad") > 0), z))
    method = F.when(x <= 0, "nonpositive_amount").when(F.abs("robust_z") > cut, "source_measure_log_mad")
    return judged.withColumn("method", method).filter("method is not null").withColumn("group_count", F.coalesce("group_count", F.lit(0))).drop("centre", "mad")


def source_quality(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source, also of those without records: known and classified shares."""
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    got = records.groupBy("source").agg(
        F.count("*").alias("total_records"), F.count("amount").alias("value_known_count"), F.count_if(F.col("amount").isNull()).alias("value_missing_count"),
        rate(F.col("amount").isNull()).alias("value_missing_rate"), rate(filled("entity")).alias("entity_known_rate"), rate(F.col("period").isNotNull()).alias("period_known_rate"),
        rate(filled("title")).alias("title_known_rate"), rate(filled("fund") & (F.col("fund") != "unspecified")).alias("fund_classified_rate"),
    )
    counts = ("total_records", "value_known_count", "value_missing_count")
    return sources.select("source").join(got, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def upper_medians(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, upper_median): the element at floor(n / 2) of the sorted values."""
    return middle_values(value_counts(rows, group, value), group, value).select(*group, F.col("high").alias("upper_median"))
