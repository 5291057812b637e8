"""Mix sources to target weights: repetition rates and hash-seeded copies. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.common import free_name
from panelweave.plans.storage import durable

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size, target) per source from rows (source, size).

    All sizes are shared out by weight. A target stops at ``most`` times its
    source's size; what it leaves is shared again by weight. In order of cap
    over weight, the stopped sources come first, so running sums find the level
    at which the others' targets end.
    """
    # counts are combined within tasks first, so one window row stands for a source; the windows over all sources run in one task
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    caps = per.select("source", "source_size", w.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    done, left = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    # the level if all sources before this one stop at their caps and no later one does
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("weight").over(left)
    levels = caps.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(Window.partitionBy())
    return levels.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce(found["level"], F.lit(0.0))).alias("target"))


def unit_hash(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def plan_names(docs: DataFrame) -> list[str]:
    """What mixture_plan() calls its four columns beside those of docs."""
    return [free_name(c, docs.columns) for c in ("mix_size", "mix_source_size", "mix_target", "mix_copies")]


def mixture_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs with mix_size, mix_source_size, mix_target and mix_copies (names that docs has get underscores, plan_names()).

    A document's size is its number of words (null or blank text: 0). Sources
    in code-point order, null last, take the weights in turn. A source's rate
    is target / size; each document gets floor(rate) copies plus one with
    probability rate - floor(rate), by a hash of its id (null: empty). The same
    input gives the same copies. A source of size 0 has target 0 and no copies;
    rows that repeat an id share their draw; an empty table gives no rows.
    """
    size, source_size, target, copies = plan_names(docs)
    rows = docs.withColumn(size, word_count(F.col(text_col)))
    targets = durable(source_targets(rows.select(F.col(source_col).alias("source"), F.col(size).alias("size")), weights, most), "targets")
    targets = targets.select(F.col("source").alias(free_name("source", rows.columns)), F.col("source_size").alias(source_size), F.col("target").alias(target))
    # a written table of one row a source: Spark broadcasts it where its files are small
    key = targets.columns[0]
    rows = rows.join(targets, rows[source_col].eqNullSafe(targets[key]), "left").drop(targets[key])
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)
    return rows.withColumn(copies, (F.floor(rate) + (unit_hash(seed, F.col(id_col)) < rate - F.floor(rate)).cast("long")).cast("long"))


def mix(docs: DataFrame, copy_col: str = "copy", **options) -> DataFrame:
    """docs with every document repeated mix_copies times, numbered from 1 in ``copy_col``, the last column (with underscores where docs has the name)."""
    names = plan_names(docs)
    plan = mixture_plan(docs, **options).filter(F.col(names[3]) > 0)
    return plan.withColumn(free_name(copy_col, plan.columns), F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[3])))).drop(*names)
