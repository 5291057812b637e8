"""Benchmark decontamination by SimHash of item-sized windows. DataFrame functions only.

A window can only be like an item if it has one of the item's anchors, the
rarest of its shingles that make up half of its weight; an anchor also says
where an item-sized window would have to start. Windows at
those places get 64-bit SimHash fingerprints. Of two fingerprints within the
radius, one of radius // 3 + 1 blocks differs in two bits at most, so a join of
blocks with the blocks around each item's finds all of them; the exact
weighted-shingle similarity decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.nativewords import shingles, word_hashes
from panelweave.plans.storage import durable

WIDTH = 5
#: Of windows at the least similarity, 0.8, one in a thousand is farther from its item (measured, README).
RADIUS = 20
#: Bits in which a block may differ.
SLACK = 2
#: Least share of an item's weight that its anchors make up.
ANCHORED = 0.5


def _bounds(radius: int, slack: int) -> list[tuple[int, int]]:
    """First and last bit (exclusive) of the blocks: if all differed in more than ``slack`` bits, the radius would be passed."""
    n = max(2, radius // (slack + 1) + 1)
    return [(64 * k // n, 64 * (k + 1) // n) for k in range(n)]


def _parts(fingerprint: Column, radius: int, slack: int) -> list[tuple[int, Column]]:
    """(width, key) of each block."""
    cut = lambda a, b: F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return [(b - a, F.lit(k).cast("long") * (1 << 40) + cut(a, b)) for k, (a, b) in enumerate(_bounds(radius, slack))]


def block_keys(fingerprint: Column, radius: int, slack: int = SLACK) -> Column:
    """One key a block."""
    return F.array(*(key for _, key in _parts(fingerprint, radius, slack)))


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def _masks(width: int, slack: int) -> Column:
    """The numbers of ``width`` bits of which ``slack`` at most are set."""
    found = F.array(F.lit(0).cast("long"))
    for _ in range(slack):
        found = F.array_distinct(F.flatten(F.transform(found, lambda m: F.transform(F.sequence(F.lit(-1), F.lit(width - 1)), lambda k: F.when(k < 0, m).otherwise(m.bitwiseOR(_bit(k)))))))
    return found


def probe_keys(fingerprint: Column, radius: int, slack: int = SLACK) -> Column:
    """The keys of all blocks within ``slack`` bits: one at least is a block key of each fingerprint within the radius."""

    def around(width: int, key: Column) -> Column:
        return F.transform(_masks(width, slack), lambda m: key.bitwiseXOR(m))

    return F.concat(*(around(*part) for part in _parts(fingerprint, radius, slack)))


def _mass(s: Column) -> Column:
    return F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x["count"] * x["weight"])


def simhash(s: Column) -> Column:
    """Fingerprint of (shingle, count, weight) structs: a bit is set where the hashes that have it outweigh the others."""

    def lean(b: Column) -> Column:
        return F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.when(F.getbit(x["shingle"], b) == 1, x["count"] * x["weight"]).otherwise(-x["count"] * x["weight"]))

    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(lean(b) > 0, _bit(b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def _prints(counted: DataFrame, *keys: str) -> DataFrame:
    """(keys, s, mass, fingerprint) from rows (keys, shingle, count, weight); a key has as many as an item's words at most."""
    # in order of the shingles, so that equal windows and items have the same sums
    lists = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("shingle", "count", "weight"))).alias("s"))
    return lists.select(*keys, "s", _mass(F.col("s")).alias("mass"), simhash(F.col("s")).alias("fingerprint"))


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, word): documents with a window like an item, the best window of each pair.

    Words are lower-cased runs of letters and digits, shingles have five words
    (an item with fewer counts whole, at its own width); word is the index of
    the window's first word. An item is compared with windows of its own number
    of words (fewer where the text ends). Similarity is the weighted Jaccard of shingle
    counts; a shingle weighs 1 + ln((1 + items) / (1 + items that have it)).

    A window as similar as asked shares more of the item's weight than the
    shingles beside its anchors have, so it has an anchor; phrases that many
    items share are anchors only of items that have little else.

    Null, empty or wordless texts and items match nothing, nor do rows with a
    null id. Rows that share a doc_id count as one document, repeated items as
    one; of different texts under one item_id, each is looked for. Texts of any length are read whole, other columns are ignored, and an
    empty table on either side gives no rows. No candidate is capped. Nothing
    is broadcast but what Spark finds small by the size of the written table.
    """
    parts = items.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text)).alias("wh")).filter("item_id is not null and size(wh) > 0").distinct().withColumn("item", F.xxhash64("item_id", "wh"))
    parts = parts.withColumn("n", F.size("wh")).withColumn("width", F.least("n", F.lit(WIDTH)))
    sized = F.coalesce(*(F.when(F.col("width") == w, shingles("wh", w)) for w in range(WIDTH, 0, -1)))
    index = durable(parts.select("item", "item_id", "n", "width", F.posexplode(sized).alias("at", "shingle")), "items")
    of = index.agg(F.countDistinct("item_id").alias("items"), F.collect_set("width").alias("widths")).first()  # five widths at most
    if not of["widths"]:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, word int").withColumn("item_id", F.col("item_id").cast(index.schema["item_id"].dataType))
    total = F.lit(float(of["items"]))
    weights = index.groupBy("shingle").agg((1 + F.log((1 + total) / (1 + F.countDistinct("item_id")))).alias("weight"))
    own = durable(index.groupBy("item", "item_id", "n", "shingle").agg(F.count("*").alias("count")).join(weights, "shingle"), "item-shingles")
    wanted = durable(_prints(own, "item", "item_id", "n"), "item-prints")

    rarest = Window.partitionBy("item").orderBy(F.col("weight").desc(), "shingle")
    mass, share = F.col("count") * F.col("weight"), max(ANCHORED, 1 - similarity + 1e-6)
    anchors = own.withColumns({"before": F.coalesce(F.sum(mass).over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "all": F.sum(mass).over(Window.partitionBy("item"))})
    anchors = anchors.filter(F.col("before") <= share * F.col("all")).select("item", "shingle")
    lookup = durable(index.join(anchors, ["item", "shingle"]).select("shingle", "n", "at").distinct(), "anchors")

    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_hashes(F.col(text_col)).alias("wh")).filter("doc_id is not null")
    each = [hashed.select("doc_id", F.posexplode(shingles("wh", w)).alias("pos", "shingle")) for w in sorted(of["widths"])]
    hits = reduce(DataFrame.unionByName, each).join(lookup, "shingle")
    places = durable(hits.select("doc_id", F.greatest(F.col("pos") - F.col("at"), F.lit(0)).alias("word"), "n").distinct(), "places")

    # only documents with a place are read again, and hashed after the join; windows of equal words count once from here on
    again = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(places.select("doc_id").distinct(), "doc_id", "left_semi")
    again = durable(again.select("doc_id", word_hashes(F.col("text")).alias("wh")), "matched")
    windows = again.join(places, "doc_id").filter("word < size(wh)").select("doc_id", "word", "n", F.slice("wh", F.col("word") + 1, F.col("n")).alias("w"))
    windows = durable(windows.withColumn("key", F.xxhash64("n", "w")), "windows")
    width = F.least(F.size("w"), F.lit(WIDTH))
    sized = F.coalesce(*(F.when(width == w, shingles("w", w)) for w in range(WIDTH, 0, -1)))
    counted = windows.dropDuplicates(["key"]).select("key", "n", F.explode(sized).alias("shingle")).groupBy("key", "n", "shingle").agg(F.count("*").alias("count"))
    weighed = counted.join(own.select("shingle", "weight").distinct(), "shingle", "left").withColumn("weight", F.coalesce("weight", 1 + F.log(1 + total)))
    found = durable(_prints(weighed, "key", "n"), "window-prints")

    left = found.select("key", "n", "fingerprint", F.col("mass").alias("x"), F.explode(block_keys(F.col("fingerprint"), radius)).alias("block"))
    right = wanted.select("item", "item_id", "n", F.col("mass").alias("y"), F.col("fingerprint").alias("other"), F.explode(probe_keys(F.col("fingerprint"), radius)).alias("block"))
    near = left.join(right, ["n", "block"]).filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= radius).select("key", "item", "item_id", "x", "y").distinct()
    theirs = found.select("key", F.explode("s").alias("t")).select("key", F.col("t.shingle").alias("shingle"), F.col("t.count").alias("count"))
    shared = near.join(theirs, "key").join(own.select("item", "shingle", F.col("count").alias("has"), "weight"), ["item", "shingle"])
    scored = shared.groupBy("key", "item", "item_id", "x", "y").agg(F.sum(F.least("count", "has") * F.col("weight")).alias("both"))
    scored = durable(scored.select("key", "item_id", (F.col("both") / (F.col("x") + F.col("y") - F.col("both"))).alias("similarity")).filter(F.col("similarity") >= similarity - 1e-9), "alike")
    best = windows.select("doc_id", "word", "key").join(scored, "key").groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("word")).alias("from"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.from")).alias("word"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that contaminated() finds; rows with a null id stay, and so do all columns."""
    bad = durable(contaminated(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("bad")).distinct(), "contaminated")
    return docs.join(bad, docs[id_col] == bad["bad"], "left_anti")
