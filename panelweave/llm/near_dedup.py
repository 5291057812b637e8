"""MinHash near-duplicate classes with tensored banding.

Two small collections of m half-bands are computed for each document; a table
key is a pair (half-band i of the first, half-band j of the second), so that
m * m keys cost 2 * m half-bands: the number of minhashes is about the square
root of what as many independent bands would need. Candidates are verified on
full shingle sets.

Exact copies of a set collapse first, by a 128-bit digest. Within a bucket
members are compared with one pivot, then with a likely original of the rest;
of all other pairs only those remain whose ends are still in different
components and whose exact bounds (sizes, shingles that no other member has,
overlaps with the pivot) allow a link.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.textbytes import mix, shingle_sets
from panelweave.operators.graph import connected_components, extend_components
from panelweave.plans.storage import durable

SKETCH = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("digest", T.BinaryType()),
    T.StructField("a", T.ArrayType(T.LongType())),
    T.StructField("b", T.ArrayType(T.LongType())),
])
SETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.BinaryType())])


def half_bands(threshold: float, rows: int, miss: float = 5e-4) -> int:
    """Half-bands a collection needs so that a pair at the threshold shares no key with probability under ``miss``."""
    p = threshold**rows
    return math.ceil(math.log(1 - math.sqrt(1 - miss)) / math.log(1 - p)) if p < 1 else 1


def _sketch(batches, m: int, rows: int, width: int):
    rng = np.random.default_rng(97)
    times = rng.integers(0, 2**63, (2 * m * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    band = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        n, digest, least = [], [], []
        with np.errstate(over="ignore"):
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if not len(s):
                    least.append(np.zeros(2 * m * rows, np.uint64))
                    continue
                low = (s[None, :4096] * times).min(1)
                for k in range(4096, len(s), 4096):
                    low = np.minimum(low, (s[None, k : k + 4096] * times).min(1))
                least.append(low)
            half = mix((np.array(least, np.uint64).reshape(-1, 2 * m, rows) * band).sum(2, dtype=np.uint64)).view(np.int64)
        a, b = (pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * m + 1, m), pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1))) for x in (half[:, :m], half[:, m:]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), a, b], names=SKETCH.names)


def _sets(batches, width: int):
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), width)], pa.binary())], names=SETS.names)


def _exploded(batches):
    """(shingle, node) rows of sorted sets."""
    for batch in batches:
        for node, s in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = np.frombuffer(s.as_buffer(), np.int64)
            for k in range(0, len(s), 1 << 16):
                part = s[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), node))], names=["shingle", "node"])


def _shared(batches):
    """(u, v, shared): how many shingles two sorted sets have in common."""
    for batch in batches:
        out = np.zeros(batch.num_rows, np.int64)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            out[k] = (y[np.minimum(at, len(y) - 1)] == x).sum()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["u", "v", "shared"])


def _join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the corpus: by merge, where adaptive execution splits a hot key, and never by way of the driver."""
    return left.join(right.hint("merge"), on, how)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v, nu, nv) with the exact number of shared shingles."""
    one = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    both = _join(_join(pairs.select("u", "v"), one, "u"), two, "v").select("u", "v", "x", "y")
    found = both.mapInArrow(_shared, "u long, v long, shared long")
    return _join(pairs, found.groupBy("u", "v").agg(F.max("shared").alias("shared")), ["u", "v"])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, rows: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are maximal runs of other than ASCII white space, A-Z lower-cased;
    a document's set is its distinct ``width``-word shingles (its whole word
    sequence if shorter). Rows whose sets have 100 * shared >= t * union, t =
    round(100 * threshold), are linked; component_id is the least doc_id that
    links reach.

    A null or blank text has an empty set (n_shingles 0) and is linked with
    nothing. Rows that share a doc_id count as one document: a link of any of
    them joins it. A row with a null doc_id takes no part: component_id null,
    kept true. Texts of any length count whole; other columns are ignored; an
    empty table gives an empty result.

    A pair at the threshold is found with probability 0.9995 or more, a closer
    one more surely still; no bucket, partner or candidate is capped.
    """
    percent, m = round(100 * threshold), half_bands(threshold, rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = durable(texts.mapInArrow(partial(_sketch, m=m, rows=rows, width=width), SKETCH), "sketch")

    # classes of equal sets: counts per digest are combined before the shuffle
    full = sketch.filter("n > 0 and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    many = durable(classes.filter("copies > 1").select("digest", "node"), "classes")
    # one row stands for its class: the others are shed before any candidate search
    stands = _join(full, many, "digest", "left").filter("node is null or node = doc_id").select(F.col("doc_id").alias("node"), "n", "a", "b")

    keys = (
        stands.select("node", "n", F.posexplode("a").alias("i", "x"), "b")
        .select("node", "n", "i", "x", F.posexplode("b").alias("j", "y"))
        .select(F.xxhash64("i", "x", "j", "y").alias("key"), "node", "n")
    )
    pivots = keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("p"), F.max("node").alias("last")).filter("p.node <> last")
    buckets = durable(_join(keys, pivots.select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("np")), "key").distinct(), "buckets")

    def fits(x, y):
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    star = buckets.filter(fits(F.col("n"), F.col("np")) & (F.col("node") != F.col("pivot")))
    star = durable(star.select(F.col("pivot").alias("u"), F.col("node").alias("v"), F.col("np").alias("nu"), F.col("n").alias("nv")).distinct(), "star")
    # sets are needed of bucket members only
    members = buckets.select(F.col("node")).distinct()
    sets = _join(texts, members.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    sets = durable(sets.mapInArrow(partial(_sets, width=width), SETS), "sets")
    linked = 100 * F.col("shared") >= percent * (F.col("nu") + F.col("nv") - F.col("shared"))
    first = _verify(star, sets)
    links = durable(first.filter(linked).select("u", "v"), "links")
    comps = durable(connected_components(links), "components")

    # what is left of each bucket that still spans components
    def open_rows(rows: DataFrame, comps: DataFrame) -> DataFrame:
        placed = _join(rows, comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        spans = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1")
        return _join(placed, spans.select("key"), "key", "left_semi")

    rest = durable(open_rows(buckets, comps).filter("node <> pivot").select("key", "node", "n"), "open")
    # shingles that no other open member has cannot be shared: they bound what a pair can have in common
    loose = _join(sets, rest.select("node").distinct(), "node", "left_semi").mapInArrow(_exploded, "shingle long, node long")
    own = loose.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).filter("node = last").groupBy("node").agg(F.count("*").alias("own"))
    rest = _join(rest, own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    rest = durable(rest.filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")), "bounded")
    # a second pivot: the member with the fewest shingles of its own is the likeliest original of the others
    centre = rest.groupBy("key").agg(F.min(F.struct("own", "node", "n")).alias("p"))
    rest = _join(rest, centre.select("key", F.col("p.node").alias("centre"), F.col("p.n").alias("nc")), "key")
    star = rest.filter(fits(F.col("n"), F.col("nc")) & (F.col("node") != F.col("centre")))
    star = durable(star.select(F.col("centre").alias("u"), F.col("node").alias("v"), F.col("nc").alias("nu"), F.col("n").alias("nv")).distinct(), "star")
    second = durable(_verify(star, sets), "verified")
    comps = durable(extend_components(comps, second.filter(linked).select("u", "v")), "components")
    within = second.select(F.col("u").alias("centre"), F.col("v").alias("node"), F.col("shared").alias("inside"))
    rest = durable(_join(open_rows(rest.filter("node <> centre"), comps), within, ["centre", "node"], "left"), "open")

    # a pair that meets in several buckets counts in the first of them only (a node has m * m keys at most)
    rest = _join(rest, rest.groupBy("node").agg(F.collect_set("key").alias("keys")), "node")
    # all pairs over two components whose sizes, own shingles and overlap with the centre allow a link
    x, y = rest.alias("x"), rest.alias("y")
    common = F.expr("""
        least(x.n - x.own, y.n - y.own,
              if(x.inside is null or y.inside is null, null,
                 least(x.inside, y.inside) + least(x.n - x.own - x.inside, y.n - y.own - y.inside)))""")
    able = F.expr("x.key = y.key and x.component < y.component") & (100 * common >= percent * (F.col("x.n") + F.col("y.n") - common))
    able = able & F.expr("x.key = array_min(array_intersect(x.keys, y.keys))")
    pairs = x.join(y.hint("merge"), able).select("x.node", "x.n", F.col("y.node").alias("other"), F.col("y.n").alias("m"))
    pairs = durable(pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"), F.when(F.col("node") < F.col("other"), F.col("n")).otherwise(F.col("m")).alias("nu"), F.when(F.col("node") < F.col("other"), F.col("m")).otherwise(F.col("n")).alias("nv")).distinct(), "pairs")
    third = durable(_verify(pairs, sets), "verified").filter(linked).select("u", "v")
    comps = durable(extend_components(comps, third), "components")

    out = _join(sketch.select("doc_id", "n", "digest"), many, "digest", "left")
    out = out.withColumn("node", F.when(F.col("n") > 0, F.coalesce("node", "doc_id")).otherwise(F.col("doc_id")))
    out = _join(out, comps, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_repeated_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of each doc_id, of several the one whose columns come first in order; rows with a null id stay."""
    known = docs.filter(F.col(id_col).isNotNull())
    repeated = known.groupBy(id_col).agg(F.count("*").alias("__n")).filter("__n > 1").select(id_col)
    again = known.join(repeated, id_col, "left_semi").groupBy(id_col).agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return docs.join(repeated, id_col, "left_anti").unionByName(again.select(*docs.columns))
