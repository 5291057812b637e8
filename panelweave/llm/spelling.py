"""Spelling variants: words at one edit from each other, and the form that each goes back to.

Two words at one edit share the first or the second half of the shorter one.
So the dictionary is kept twice, by beginnings and by ends of words (reversed
words, sorted); words that stand together under a shared half form a block. A
block with many words is cut again: what is left of its words between the
shared beginning and the shared end is at one edit too, and one half of it is
whole. Pairs of blocks that are small enough, or cannot be cut further, are
verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.plans.storage import drop, durable, durable_with, written

LETTERS = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _spelled(doc: str, run: str, one_in: int) -> str:
    """The run, without one code point where the crc32 of document and run is a multiple of one_in."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    return run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]


def _count(batches, one_in: int, least_length: int, most: int):
    """Partial counts of words, given out whenever there are ``most`` different ones."""
    total: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            plain = (text.as_py() or "").encode().translate(_LOWER).decode()
            name = "" if doc is None else str(doc)
            for run, n in Counter(LETTERS.findall(plain)).items():
                word = _spelled(name, run, one_in) if one_in else run
                if len(word) >= least_length:
                    total[word] += n
            if len(total) >= most:
                yield flush()
    if total:
        yield flush()


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, one_in: int = 0, id_col: str = "doc_id", text_col: str = "text", most: int = 200_000) -> DataFrame:
    """(word, n): words of ``least_length`` code points that occur ``least_count`` times in the whole table.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.
    With one_in, runs whose crc32 with the document's id is a multiple of it
    lose one code point first: misspellings made on purpose, to measure by.
    """
    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    counted = rows.mapInArrow(partial(_count, one_in=one_in, least_length=least_length, most=most), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _cut(blocks: DataFrame) -> DataFrame:
    """Two blocks for each row: by the first and by the second half of what no shared beginning or end covers.

    len is the length of the shorter words of the block, from and to are how
    much is shared at either end; the block's key hashes what is shared.
    """
    half = F.floor((F.col("len") - F.col("from") - F.col("to")) / 2).cast("int")
    first = F.struct((F.col("from") + half).alias("from"), F.col("to").alias("to"))
    second = F.struct(F.col("from").alias("from"), (F.col("len") - F.col("from") - half).alias("to"))
    size = F.length("word")
    cut = blocks.select("word", "n", "len", F.explode(F.array(first, second)).alias("s")).select("word", "n", "len", "s.from", "s.to")
    key = F.xxhash64(F.col("len"), F.col("from"), F.col("to"), F.substring("word", F.lit(1), F.col("from")), F.substring("word", size - F.col("to") + 1, F.col("to")))
    return cut.withColumn("key", key)


def near_words(words: DataFrame, block: int = 64, rounds: int = 40) -> DataFrame:
    """(word, n, other, other_n): both directions of all pairs at exactly one inserted, deleted or replaced code point.

    words has one row a word. Blocks of more than ``block`` words are cut
    until they are smaller or only one place is open; ``rounds`` bounds the
    halvings of words of any length below 2**rounds.
    """
    rows = words.select("word", "n")
    # a word is the shorter, or an equal, of pairs under its own length, and the longer under one less
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1))
    blocks = rows.withColumn("len", lengths).filter("len >= 1").withColumns({"from": F.lit(0), "to": F.lit(0)})
    whole = None
    for _ in range(rounds):
        cut = _cut(blocks)
        open_places = F.col("len") - F.col("from") - F.col("to")
        sizes = cut.groupBy("key").agg(F.count("*").alias("size"), F.count(F.when(F.length("word") == F.col("len"), 1)).alias("short"))
        # a block without a word of its own length, or of one word, has no pairs
        met = cut.join(sizes.filter("size > 1 and short > 0"), "key").withColumn("large", (F.col("size") > block) & (open_places > 1))
        met, seen = durable_with(met, "word-blocks", {"large": F.count(F.when(F.col("large"), 1))})
        small = met.filter(~F.col("large"))
        whole = small if whole is None else whole.unionByName(small)
        if not seen["large"]:
            break
        blocks = met.filter("large").select("word", "n", "len", "from", "to")
    short = whole.filter(F.length("word") == F.col("len")).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    other = whole.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    # pairs of equal length once; a longer word meets shorter ones only
    pairs = short.join(other, "key").filter((F.length("b") > F.length("a")) | (F.col("a") < F.col("b"))).filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))))
    return pairs.select(sides.alias("s")).select("s.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): chains of forms are halved in each round."""
    now = durable(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = now.join(next_, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        now, seen = durable_with(step, "spelling-roots", {"moved": F.count(F.when(F.col("moved"), 1))})
        now = now.select("word", "root")
        if not seen["moved"]:
            return now


def spelling_variants(words: DataFrame, times: int = 2, block: int = 64) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of words (word, n), which are distinct.

    form is the near word of largest n (ties: the smallest in code-point
    order), if that is ``times`` the word's n or more; root is where following
    forms ends, the word itself if it has none; n_near counts near words. A
    form is more frequent than its word, so chains end.
    """
    spark = words.sparkSession
    words = durable(words, "words")
    before = written(spark)
    near = near_words(words, block)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    joined = durable(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best")), "spelling-forms")
    made = [p for p in written(spark) if p not in before]
    drop(spark, made[:-1])  # the blocks; the last is what was joined
    forms = joined.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    roots = _roots(forms.filter("form is not null"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
