"""The whole build: raw files to records, links, reviews, panels, statistics and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.clean import stable_id
from panelweave.operators import breaks, matching, panel, publish, review, stats
from panelweave.plans.storage import durable
from panelweave.sources import adapters, files

FIRST, LAST = 2000, 2024
#: Sources with amounts; the other one has capacities.
AMOUNTS = ("aiddata", "codf", "cla", "cancel", "restruct", "cofi", "cgef", "chapo")
CAPACITY = {"cgp": "cgp_capacity_mw"}
DECISIONS = "candidate_id string, review_decision string"


def flagged_outliers(records: DataFrame) -> DataFrame:
    """Candidate outliers of each source, price basis and measure, with an outlier_id."""
    known = records.filter("amount is not null").select("record_key", "source", "price_basis", "amount_measure", "amount")
    found = stats.outliers(known, ["source", "price_basis", "amount_measure"])
    return found.withColumn("outlier_id", stable_id("OUT", F.col("record_key")))


def panel_tables(records: DataFrame, entities: DataFrame, first: int = FIRST, last: int = LAST) -> dict[str, DataFrame]:
    """skeleton, wide, long and long_fund of records."""
    keys = ["entity", "period"]
    able = panel.eligible(records, entities, first, last)
    wide = panel.wide_panel(records, entities, (*AMOUNTS, *CAPACITY), first, last)
    for more in (panel.metric_columns(able, keys, CAPACITY), panel.fund_columns(able, keys)):
        wide = panel.attach(wide, more, keys)
    return {
        "skeleton": panel.skeleton(entities, first, last),
        "wide": wide,
        "long": panel.long_panel(records, entities, AMOUNTS, first, last),
        "long_fund": panel.long_fund_panel(records, entities, first, last),
    }


def build(spark: SparkSession, folder: str, decisions: DataFrame | None = None) -> dict[str, DataFrame]:
    """All published tables of a folder of raw files, by name.

    Links come from references and titles; decisions of reviewers (candidate_id,
    review_decision) join more. Outliers are flagged, never deleted: robustness
    compares correlations with and without them.
    """
    raw = durable(adapters.all_records(spark, folder).drop("project_match_id"), "records")  # read by every step
    matched, candidates = matching.apply_matching(raw)
    said = spark.createDataFrame([], DECISIONS) if decisions is None else decisions
    reviewed, applied = review.apply_decisions(durable(matched, "matched"), candidates, said)
    done = applied.filter("application_status = 'applied'").select("candidate_id").distinct()
    pending = candidates.join(done, "candidate_id", "left_anti").filter("status = 'needs_review'")
    records = durable(review.reconcile(reviewed, pending), "reviewed")
    outliers = flagged_outliers(records)
    flagged = outliers.select("record_key").distinct()
    entities = adapters.sovereign(files.read_csv(spark, f"{folder}/fdi_africa_metadata.csv"))
    tables = panel_tables(records, entities)
    metric = lambda long: long.select(F.col("source").alias("metric"), "entity", "period", F.col("total").alias("value"), F.col("record_count").alias("row_count"))
    metrics = durable(metric(tables["long"]), "metrics")
    without = panel.long_panel(records.join(flagged, "record_key", "left_anti"), entities, AMOUNTS, FIRST, LAST)
    correlated = stats.correlations(metrics)
    totals = metrics.groupBy(F.col("metric").alias("series"), "period").agg(panel.money("value").alias("value"))
    models = breaks.mean_breaks(totals)
    return tables | {
        "records": records, "candidates": candidates, "applied": applied, "queue": review.review_queue(pending, records), "groups": matching.match_groups(records), "entities": matching.entity_index(records), "outliers": outliers,
        "missingness": panel.missingness(metrics), "descriptive": stats.describe(metrics), "trends": stats.period_trends(metrics), "summary": stats.entity_summary(metrics), "correlations": correlated,
        "robustness": stats.robustness(correlated, stats.correlations(metric(without))), "models": models, "breakpoints": breaks.breakpoints(totals, models),
    }


def check(built: dict[str, DataFrame]) -> DataFrame:
    """(check, failures) over a build; zeros only if it is sound."""
    b = built
    return publish.checks(
        publish.panel_checks(b["skeleton"], b["wide"], b["long"], b["records"], b["groups"], b["entities"], b["missingness"], AMOUNTS),
        publish.statistics_checks(b["trends"], b["summary"], b["correlations"], b["robustness"], b["models"], b["breakpoints"]),
        publish.within("pending_records_are_queued", b["records"].filter("match_status = 'needs_review'").select("record_key"), b["queue"].select(F.explode(F.array("left_key", "right_key")).alias("record_key")), ["record_key"]),
        publish.within("outliers_are_records", b["outliers"], b["records"], ["record_key"]),
        publish.holds("application_status_is_known", b["applied"], F.col("application_status").isin("applied", "candidate_not_found", "invalid_decision")),
    )
