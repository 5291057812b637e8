"""Filters, rankings and series that a dashboard asks for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.operators.panel import money


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows one of whose columns contains text, whatever its case; an empty text keeps all."""
    needle = text.strip().lower()
    if not needle:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle)
    return df.filter(hit)


REVIEW_FIELDS = ("candidate_id", "entity", "left_source", "left_record_id", "left_title", "right_source", "right_record_id", "right_title")
CATALOGUE_FIELDS = ("name", "short_name", "level", "amount_basis", "description")


def filter_reviews(queue: DataFrame, status: str = "all", hint: str = "all", text: str = "") -> DataFrame:
    """Rows of a queue with a review_decision column: all, pending (no decision yet) or one decision, and one hint."""
    out = search(queue, text, REVIEW_FIELDS)
    if status != "all":
        out = out.filter(F.coalesce("review_decision", F.lit("")) == ("" if status == "pending" else status))
    return out if hint == "all" else out.filter(F.col("review_hint") == hint)


def filter_entities(overview: DataFrame, least_sources: int = 0, text: str = "", names: Sequence[str] = ("entity",)) -> DataFrame:
    """Entities with that many sources at least whose names, joined by spaces, contain text."""
    joined = F.concat_ws(" ", *names)
    return search(overview.filter(F.col("source_count") >= least_sources).withColumn("__names", joined), text, ["__names"]).drop("__names")


def filter_category(rows: DataFrame, category: str = "all", text: str = "", fields: Sequence[str] = CATALOGUE_FIELDS) -> DataFrame:
    """Rows of a category ("all": any) whose fields, joined by spaces, contain text."""
    able = rows if category == "all" else rows.filter(F.col("category") == category)
    return search(able.withColumn("__fields", F.concat_ws(" ", *fields)), text, ["__fields"]).drop("__fields") if text.strip() else able


def catalogue_totals(rows: DataFrame) -> DataFrame:
    """Records, the most countries of a source, and the years they span; zeros and NULL where nothing is left."""
    return rows.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.max("countries"), F.lit(0)).alias("most_countries"), F.min("first").alias("first"), F.max("last").alias("last"))


def entity_order(mode: str = "records") -> list[Column]:
    """Sort keys of a mode: records, sources (then records) or name (by Unicode rules, so accents stand beside their letters); ties by entity."""
    modes = {"records": [F.col("records").desc()], "sources": [F.col("source_count").desc(), F.col("records").desc()], "name": [F.collate("entity", "UNICODE")]}
    return [*modes[mode], F.col("entity")]


def rank_entities(overview: DataFrame, mode: str = "records") -> DataFrame:
    """overview in the order of a sort mode."""
    return overview.orderBy(*entity_order(mode))


def covered_entities(records: DataFrame, first: int, last: int) -> DataFrame:
    """How many entities have a record between two periods."""
    return records.filter(F.col("period").between(first, last)).agg(F.countDistinct("entity").alias("covered"))


def entity_overview(records: DataFrame) -> DataFrame:
    """Per entity: records, distinct sources with data, and counts keyed by source and by period."""
    by = lambda key: records.groupBy("entity", key).agg(F.count("*").alias("n")).groupBy("entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), "n")))).alias(f"by_{key}"))
    totals = records.groupBy("entity").agg(F.count("*").alias("records"), F.countDistinct("source").alias("source_count"), F.min("period").alias("first"), F.max("period").alias("last"))
    return totals.join(by("source"), "entity").join(by("period"), "entity")


def overview_json(overview: DataFrame) -> DataFrame:
    return overview.select("entity", F.to_json(F.struct(*sorted(overview.columns))).alias("payload"))


def series(records: DataFrame, source: str, first: int, last: int) -> DataFrame:
    """Record counts of a source in every period from first to last, zero where there is none."""
    spark = records.sparkSession
    frame = spark.range(first, last + 1).select(F.col("id").cast("int").alias("period"))
    counts = records.filter(F.col("source") == source).groupBy("period").agg(F.count("*").alias("n"))
    return frame.join(counts, "period", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def series_facts(points: DataFrame) -> DataFrame:
    """Total, first peak period and active periods of a zero-filled series."""
    return points.agg(F.sum("n").alias("total"), F.max_by("period", F.struct("n", (-F.col("period")).alias("p"))).alias("peak_period"), F.max("n").alias("peak"), F.count_if(F.col("n") > 0).alias("active_periods"))


def count_between(records: DataFrame, first: int, last: int) -> DataFrame:
    return records.groupBy("entity").agg(F.count_if(F.col("period").between(first, last)).alias("n"))


def top(records: DataFrame, by: str, k: int) -> DataFrame:
    """The k largest groups, ties by name."""
    return records.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by).limit(k)


def findings(records: DataFrame) -> DataFrame:
    """Per source: its first peak period and its top entity by total."""
    per = records.groupBy("source", "period").agg(money("amount").alias("v"))
    peak = per.groupBy("source").agg(F.max_by(F.struct("period", "v"), F.struct("v", (-F.col("period")).alias("p"))).alias("x"))
    ent = records.groupBy("source", "entity").agg(money("amount").alias("v"))
    first = ent.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.col("v").desc(), "entity"))).filter("r = 1")
    return peak.select("source", F.col("x.period").alias("peak_period"), F.col("x.v").alias("peak_value")).join(first.select("source", F.col("entity").alias("top_entity"), F.col("v").alias("top_value")), "source")


def source_audit(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Per source: rows, rows of known entities, their share, and the share with an amount."""
    known = entities.select("entity").distinct().withColumn("mapped", F.lit(True))
    m = records.join(known, "entity", "left")
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    mapped = F.coalesce("mapped", F.lit(False))
    return m.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(mapped).alias("mapped_rows"), rate(mapped).alias("mapped_rate"), rate(F.col("amount").isNotNull()).alias("metric_known_rate"), F.min("period").alias("first"), F.max("period").alias("last"))
