"""Balanced entity-by-period panels out of independent sources.

Amounts are summed within a source only, and a cell without an observation is
NULL, not zero; counts of such a cell are zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(amount: str | Column) -> Column:
    """An exact sum of amounts: decimals do not depend on the order of rows."""
    c = F.col(amount) if isinstance(amount, str) else amount
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def skeleton(entities: DataFrame, first: int, last: int, period: str = "period") -> DataFrame:
    """Every entity in every period: the one cross product, with a fixed sequence."""
    return entities.distinct().withColumn(period, F.explode(F.sequence(F.lit(first), F.lit(last))))


def eligible(records: DataFrame, entities: DataFrame, first: int, last: int, entity: str = "entity", period: str = "period") -> DataFrame:
    """Records of panel entities within the panel's periods."""
    return records.filter(F.col(period).between(first, last)).join(entities.select(entity).distinct(), entity, "left_semi")


def source_cells(records: DataFrame, keys: Sequence[str] = ("entity", "period", "source")) -> DataFrame:
    """Count, known amounts and their sum per cell."""
    return records.groupBy(*keys).agg(F.count("*").alias("record_count"), F.count("amount").alias("known_count"), money("amount").alias("total"))


def long_panel(records: DataFrame, entities: DataFrame, sources: Sequence[str], first: int, last: int) -> DataFrame:
    """One row per entity, period and source, observed or not."""
    frame = skeleton(entities, first, last).withColumn("source", F.explode(F.array(*map(F.lit, sources))))
    cells = frame.join(source_cells(eligible(records, entities, first, last)), ["entity", "period", "source"], "left")
    return cells.withColumns({"record_count": F.coalesce("record_count", F.lit(0)), "known_count": F.coalesce("known_count", F.lit(0))})


def wide_panel(records: DataFrame, entities: DataFrame, sources: Sequence[str], first: int, last: int, names: Sequence[str] | None = None) -> DataFrame:
    """One row per entity and period; columns {name}_count and {name}_total in the order of sources."""
    names = list(names or sources)
    cells = eligible(records, entities, first, last).groupBy("entity", "period").pivot("source", list(sources)).agg(F.count(F.lit(1)).alias("count"), money("amount").alias("total"))
    wide = skeleton(entities, first, last).join(cells, ["entity", "period"], "left")
    out = []
    for source, name in zip(sources, names):
        out += [F.coalesce(F.col(f"`{source}_count`"), F.lit(0)).alias(f"{name}_count"), F.col(f"`{source}_total`").alias(f"{name}_total")]
    return wide.select("entity", "period", *out)


def long_fund_panel(records: DataFrame, entities: DataFrame, first: int, last: int) -> DataFrame:
    """Observed cells by fund type."""
    return source_cells(eligible(records, entities, first, last), ("entity", "period", "source", "fund"))


def fund_columns(records: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """A total per source and fund type as columns, in the order of pairs; without pairs, a column {source}_{fund}_usd for each pair that has an amount, in sorted order."""
    if pairs is None:
        named = records.filter(F.col("amount").isNotNull()).withColumn("__pair", F.concat_ws("_", "source", "fund", F.lit("usd")))
        return records.select(*keys).distinct().join(named.groupBy(*keys).pivot("__pair").agg(money("amount")), list(keys), "left")
    sums = [money(F.when((F.col("source") == s) & (F.col("fund") == f), F.col("amount"))).alias(n) for (s, f), n in zip(pairs, names)]
    return records.groupBy(*keys).agg(*sums)


def metric_columns(records: DataFrame, keys: Sequence[str], columns: dict[str, str], metric: str = "metric_value") -> DataFrame:
    """Sums of a physical measure as columns: source -> name. Sources do not mix, and a sum without any known part is NULL."""
    return records.groupBy(*keys).agg(*(F.round(F.sum(F.when(F.col("source") == s, F.col(metric))), 6).alias(n) for s, n in columns.items()))


def unpivot_metrics(wide: DataFrame, ids: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """(ids, metric, value) rows from metric -> column."""
    renamed = wide.select(*ids, *(F.col(c).cast("double").alias(m) for m, c in columns.items()))
    return renamed.unpivot(list(ids), list(columns), "metric", "value")


def periods_from_parts(parts: DataFrame, keys: Sequence[str], measures: Sequence[str], legacy_zero: bool = False) -> DataFrame:
    """Finer rows summed to a coarser period, with the number of rows.

    A measure with no known part is NULL; legacy_zero gives 0 instead.
    """
    total = lambda m: F.coalesce(money(m), F.lit(0.0)) if legacy_zero else money(m)
    return parts.groupBy(*keys).agg(*(total(m).alias(m) for m in measures), F.count("*").alias("row_count"))


def last_row(rows: DataFrame, keys: Sequence[str], ordinal: str, values: Sequence[str]) -> DataFrame:
    """The values of each key's last row: later rows overwrite earlier ones."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(ordinal)).alias("r")).select(*keys, *(F.col(f"r.{v}").alias(v) for v in values))


def attach(panel: DataFrame, macro: DataFrame, keys: Sequence[str]) -> DataFrame:
    """panel with a macro source's columns; keys that only macro has are left out."""
    return panel.join(macro, list(keys), "left")


def missingness(long: DataFrame, entity: str = "entity", period: str = "period") -> DataFrame:
    """Per metric of a long panel: observed, missing, zero and negative cells, and the span observed."""
    known = F.col("value").isNotNull()
    return long.groupBy("metric").agg(
        F.count("*").alias("panel_rows"),
        F.count("value").alias("observed_count"),
        F.count_if(~known).alias("missing_count"),
        F.round(F.count_if(~known) / F.count("*"), 6).alias("missing_rate"),
        F.count_if(F.col("value") == 0).alias("zero_count"),
        F.count_if(F.col("value") < 0).alias("negative_count"),
        F.countDistinct(F.when(known, F.col(entity))).alias("entities_with_data"),
        F.countDistinct(F.when(known, F.col(period))).alias("periods_with_data"),
        F.min(F.when(known, F.col(period))).alias("first_observed"),
        F.max(F.when(known, F.col(period))).alias("last_observed"),
    )
