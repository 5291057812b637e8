"""Published order of tables, their checks, and the build report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.plans.storage import durable


def _by_size(c: str) -> Column:
    """From the largest magnitude; NULL counts as zero."""
    return F.abs(F.coalesce(F.col(c), F.lit(0.0))).desc()


def order_of(table: str) -> list[Column]:
    """Sort keys of a published table; together they are unique."""
    return {
        "candidates": [F.col("similarity").desc(), F.col("candidate_id")],
        "groups": [F.col("entity"), F.col("period").cast("string"), F.col("project_match_id")],
        "entities": [F.col("entity"), F.col("period").cast("string"), F.col("project_entity_id")],
        "outliers": [_by_size("robust_z"), F.col("outlier_id")],
        "correlations": [_by_size("spearman_rho"), F.col("left_metric"), F.col("right_metric"), F.col("scope")],
        "robustness": [_by_size("baseline_spearman"), F.col("left_metric"), F.col("right_metric"), F.col("scope")],
        "breakpoints": [F.col("bic_improvement").desc(), F.col("series"), F.col("break_number")],
        "most_common": [F.col("n").desc(), F.col("first_seen")],
    }[table]


def in_order(df: DataFrame, table: str) -> DataFrame:
    """df sorted as it is published: a range partitioning, then a sort of each part."""
    return df.orderBy(*order_of(table))


def numbered(df: DataFrame, *keys: Column | str) -> DataFrame:
    """df with position, from 1, in the order of keys; no task holds the table.

    Rows are sorted by ranges and written, so that numbers within a part and
    the sizes of the parts before it, one row a part on the driver, add up.
    """
    spark = df.sparkSession
    sorted_ = durable(df.orderBy(*keys).withColumn("__row", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__row", 33)
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "__part long, __before long"))  # one row a part
    position = F.col("__before") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return sorted_.join(offsets, part == F.col("__part")).withColumn("position", position).drop("__row", "__part", "__before")


def most_common(rows: DataFrame, value: str, ordinal: str) -> DataFrame:
    """(value, n, first_seen): counts from the most common on; ties in order of first appearance."""
    return in_order(rows.groupBy(value).agg(F.count("*").alias("n"), F.min(ordinal).alias("first_seen")), "most_common")


# --- checks ----------------------------------------------------------------


def _failures(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")


def unique(name: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that stand in several rows."""
    return _failures(name, df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"))


def holds(name: str, df: DataFrame, condition: Column) -> DataFrame:
    """Rows that break a condition; NULL breaks it."""
    return _failures(name, df.filter(~F.coalesce(condition, F.lit(False))))


def within(name: str, part: DataFrame, whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values of part that whole lacks."""
    k = list(keys)
    return _failures(name, part.select(*k).distinct().join(whole.select(*k).distinct(), k, "left_anti"))


def equal_sets(name: str, left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that only one of two tables has."""
    k = list(keys)
    a, b = left.select(*k).distinct(), right.select(*k).distinct()
    return _failures(name, a.join(b, k, "left_anti").unionByName(b.join(a, k, "left_anti")))


def adds_up(name: str, df: DataFrame, total: Column, expected: DataFrame) -> DataFrame:
    """1 if the sum of a column over df is not the number of rows expected, else 0."""
    have = df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("have"))
    return have.select(F.lit(name).alias("check"), (F.col("have") != expected.agg(F.count("*")).scalar()).cast("long").alias("failures"))


def checks(*each: DataFrame) -> DataFrame:
    """(check, failures) of several checks; a sound build has zeros only."""
    return reduce(DataFrame.unionByName, each)


def panel_checks(skeleton: DataFrame, wide: DataFrame, long: DataFrame, records: DataFrame, groups: DataFrame, entities: DataFrame, missing: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Invariants of a panel build.

    The panel has every entity and period of the skeleton once, the long panel
    every source too; missing amounts are no zeros; groups have two members or
    more; entities cover every record and carry no amount; observed and missing
    cells fill the panel.
    """
    full = skeleton.withColumn("source", F.explode(F.array(*map(F.lit, sources))))
    cells = missing.withColumn("cells", skeleton.agg(F.count("*")).scalar())
    return checks(
        unique("wide_key_is_unique", wide, ["entity", "period"]),
        equal_sets("wide_covers_skeleton", wide, skeleton, ["entity", "period"]),
        unique("long_key_is_unique", long, ["entity", "period", "source"]),
        equal_sets("long_is_balanced", long, full, ["entity", "period", "source"]),
        holds("missing_amount_is_not_zero", long.filter("known_count = 0"), F.col("total").isNull()),
        holds("group_has_two_members", groups, F.col("member_count") >= 2),
        adds_up("entities_cover_records", entities, F.col("member_count"), records),
        holds("no_amount_across_sources", entities, F.col("amount_policy") == "no_cross_source_amount_selected_or_summed"),
        holds("missingness_fills_panel", cells, F.col("observed_count") + F.col("missing_count") == F.col("cells")),
    )


def statistics_checks(trends: DataFrame, summary: DataFrame, correlated: DataFrame, robust: DataFrame, models: DataFrame, points: DataFrame) -> DataFrame:
    """Invariants of the statistics: unique keys, coefficients within -1 and 1, labels that exist, breaks within their series."""
    scope = ["scope", "left_metric", "right_metric"]
    coefficient = lambda c: F.coalesce(F.col(c).between(-1, 1), F.lit(True))
    return checks(
        unique("trend_key_is_unique", trends, ["metric", "period"]),
        unique("summary_key_is_unique", summary, ["metric", "entity"]),
        holds("spearman_in_range", correlated, coefficient("spearman_rho")),
        holds("kendall_in_range", correlated, coefficient("kendall_tau_b")),
        equal_sets("robustness_covers_correlations", correlated, robust, scope),
        holds("lineage_is_known", robust, F.col("lineage_classification").isin("likely_shared_lineage", "documented_cross_reference_overlap", "distinct_source_comparison")),
        unique("model_key_is_unique", models, ["series"]),
        holds("break_counts_agree", models.join(points.groupBy("series").agg(F.count("*").alias("found")), "series", "left"), F.size("break_indices") == F.coalesce("found", F.lit(0))),
        holds("break_within_run", points, (F.col("break_period") > F.col("pre_start")) & (F.col("break_period") <= F.col("post_end"))),
    )


def build_report(tables: dict[str, DataFrame], records: DataFrame, applied: DataFrame) -> DataFrame:
    """(section, name, value): rows of every table, records by match status, and applied decisions by kind."""
    rows = [df.agg(F.count("*").alias("value")).select(F.lit("rows").alias("section"), F.lit(name).alias("name"), "value") for name, df in sorted(tables.items())]
    status = records.groupBy(F.col("match_status").alias("name")).agg(F.count("*").alias("value")).select(F.lit("matching").alias("section"), "name", "value")
    done = applied.filter("application_status = 'applied'").groupBy(F.col("review_decision").alias("name")).agg(F.count("*").alias("value")).select(F.lit("applied").alias("section"), "name", "value")
    return reduce(DataFrame.unionByName, [*rows, status, done])
