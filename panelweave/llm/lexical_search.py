"""Ranked lexical search: an inverted index per document shard, read by WAND.

A shard is a run of documents of one task. Its index has a row a term, with
the places of documents in the shard and how often each has the term, and one
row without a term for the documents themselves. No weight is stored, so an
index stays right when the corpus grows: weights come from counts over all
shards when the index is searched.

Within a shard, documents are taken in their order, a window of them at a
time. The maximal impacts of the terms, as they stand in the shard, give each
document of the window an upper bound; a document is a pivot if the bound
exceeds the least score of the query's heap, and only pivots are scored. Terms
whose maxima together cannot exceed it select no pivots and are looked up in
documents that others have selected. Heaps of shards are merged.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.plans.storage import durable

#: Bytes of UTF-8: A-Z lower-cased; ASCII other than letters and digits separates terms.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c) in string.ascii_lowercase + string.digits else 32 for c in range(256))
INDEX = "shard long, term string, docs binary, counts binary, df long, ids array<long>"
_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("docs", pa.binary()), ("counts", pa.binary()), ("df", pa.int64()), ("ids", pa.list_(pa.int64()))])
#: The term of the row of a shard's documents; no text has it.
DOCUMENTS = ""


def terms(text: str | None) -> list[bytes]:
    """All terms of a text in order, as UTF-8."""
    return (text or "").encode().translate(_PLAIN).split()


def _shard(number: int, ids: list, sizes: list[int], postings: dict[bytes, list]):
    """Rows of one shard: its documents, then its terms in order, some at a time."""
    yield pa.RecordBatch.from_pylist([{"shard": number, "term": DOCUMENTS, "docs": np.array(sizes, "<i8").tobytes(), "counts": None, "df": 0, "ids": ids}], schema=_ARROW)
    known = sorted(postings)
    for at in range(0, len(known), 1 << 14):
        part = known[at : at + (1 << 14)]
        docs, counts = ([np.array(postings[t][k::2], "<i4").tobytes() for t in part] for k in (0, 1))
        names = pa.array([t.decode() for t in part], pa.string())
        n = len(part)
        yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), names, pa.array(docs, pa.binary()), pa.array(counts, pa.binary()), pa.array([len(d) // 4 for d in docs], pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], schema=_ARROW)


def _index(batches, most_bytes: int):
    number = TaskContext.get().partitionId() << 33
    ids, sizes, postings, read = [], [], defaultdict(list), 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_py() or ""
            own = terms(raw)
            if not own:
                continue
            if ids and read + len(raw) > most_bytes:
                yield from _shard(number, ids, sizes, postings)
                number, ids, sizes, postings, read = number + 1, [], [], defaultdict(list), 0
            for term, n in Counter(own).items():
                postings[term] += (len(ids), n)
            ids.append(doc)
            sizes.append(len(own))
            read += len(raw)
    if ids:
        yield from _shard(number, ids, sizes, postings)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 1 << 25) -> DataFrame:
    """The index of all documents that have a term, written to the shared folder.

    A shard has texts of at most ``most_bytes`` characters, or one longer text.
    A null text has no terms; a null id and repeated rows are documents like
    others; other columns are ignored; an empty table has no shards.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return durable(rows.mapInArrow(partial(_index, most_bytes=most_bytes), INDEX), "lexical-index")


def _query_terms(batches):
    """A row for each distinct term of each row's text."""
    for batch in batches:
        found = [sorted({t.decode() for t in terms(x.as_py())}) for x in batch.column(1)]
        rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([t for x in found for t in x], pa.string())], names=["item_id", "term"])


def term_weight(n: int, df: int) -> int:
    """floor(1000 * ln((2n + 2) / (2 df + 1)))"""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _margins(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """10 + (90 * size * n) div total; with larger numbers than 64 bits on the way where needed."""
    if len(sizes) and 90 * n * int(sizes.max()) >= 1 << 63:
        return np.array([10 + 90 * int(s) * n // total for s in sizes.tolist()], np.int64)
    return 10 + 90 * n * sizes // max(total, 1)


def wand(query: list[tuple[np.ndarray, np.ndarray]], ids: list, k: int, window: int = 512) -> list[tuple[int, int]]:
    """(score, place) of the k best documents of a shard with a score above 0, ties to the smaller id.

    query has (places, impacts) of each term, places ascending; ids are the
    documents' ids, by place.
    """
    query = sorted(((p, x, int(x.max())) for p, x in query if len(p) and x.max() > 0), key=lambda t: t[2])
    if not query:
        return []
    sums = np.cumsum([t[2] for t in query])
    heap: list[tuple] = []  # (-score, order of the id, place)
    least, at = 0, 0
    size = len(ids)
    cursors = [0] * len(query)
    while at < size:
        # a document with the least score so far still gets in if its id is smaller
        needed = least if len(heap) == k else 1
        first = int(np.searchsorted(sums, needed))  # terms before this one select no pivots
        if first == len(query):
            break
        # the window ends where the selecting terms have shown about ``window`` postings
        ahead = 1 + window // (len(query) - first)
        stop = size
        for t in range(first, len(query)):
            places = query[t][0]
            cursors[t] += int(np.searchsorted(places[cursors[t] :], at))
            if cursors[t] + ahead < len(places):
                stop = min(stop, int(places[cursors[t] + ahead]))
        stop = max(stop, at + 1)
        found, bounds, score = [], [], []
        for places, impacts, most in query[first:]:
            lo, hi = np.searchsorted(places, (at, stop)).tolist()
            if hi > lo:
                found.append(places[lo:hi])
                bounds.append(np.full(hi - lo, most))
                score.append(impacts[lo:hi])
        at = stop
        if not found:
            continue
        docs, back = np.unique(np.concatenate(found), return_inverse=True)
        # sums of integers under 2**53 are exact
        upper, have = (np.bincount(back, np.concatenate(x), len(docs)).astype(np.int64) for x in (bounds, score))
        rest = int(sums[first - 1]) if first else 0
        live = upper + rest >= needed  # pivots
        docs, have = docs[live], have[live]
        for t in range(first - 1, -1, -1):
            live = have + rest >= needed
            docs, have = docs[live], have[live]
            if not len(docs):
                break
            places, impacts, most = query[t]
            spot = np.minimum(np.searchsorted(places, docs), len(places) - 1)
            have = have + np.where(places[spot] == docs, impacts[spot], 0)
            rest -= most
        keep = np.flatnonzero(have >= max(needed, 1))
        if len(keep) > 4 * k:
            keep = keep[have[keep] >= np.partition(have[keep], -k)[-k]]
        heap = sorted(heap + [(-int(have[j]), _order(ids[docs[j]]), int(docs[j])) for j in keep.tolist()])[:k]
        least = -heap[-1][0] if len(heap) == k else 0
    return [(-s, place) for s, _, place in heap]


def _order(doc) -> tuple:
    """Ids ascending, null last."""
    return (doc is None, doc or 0)


def _search(key, rows: pa.Table, n: int, total: int, k: int) -> pa.Table:
    """The heaps of a block of queries in one shard; rows are the shard's documents and the terms asked for, with those who ask."""
    ids, margins, kind = [], None, rows.schema.field("items").type.value_type.field(0).type
    for row in rows.filter(pc.equal(rows["term"], DOCUMENTS)).to_pylist():
        ids, margins = row["ids"], _margins(np.frombuffer(row["docs"], "<i8"), n, total)
    by_item = defaultdict(list)
    for row in rows.filter(pc.not_equal(rows["term"], DOCUMENTS)).to_pylist():
        places, tf = np.frombuffer(row["docs"], "<i4").astype(np.int64), np.frombuffer(row["counts"], "<i4").astype(np.int64)
        impacts = term_weight(n, row["all_df"]) * (1_000_000_000 * tf // (1000 * tf + 8 * margins[places]))
        for item in row["items"]:
            by_item[item["item_id"]].append((places, impacts))
    out = [(item, ids[place], score) for item, query in by_item.items() for score, place in wand(query, ids, k)]
    return pa.table({"item_id": pa.array([r[0] for r in out], kind), "doc_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([r[2] for r in out], pa.int64())})


def _totals(batches):
    """Documents and terms of shards."""
    for batch in batches:
        sizes = [np.frombuffer(d.as_py(), "<i8") for d in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sizes], pa.int64()), pa.array([int(s.sum()) for s in sizes], pa.int64())], names=["n_docs", "n_terms"])


def search(index: DataFrame, items: DataFrame, k: int = 10, block: int = 1024, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, ties to the smaller doc_id.

    index is that of build_index(). A term's weight is floor(1000 *
    ln((2N + 2) / (2 df + 1))); a document's score sums, over the distinct
    terms of the item, weight * (10**9 tf div (1000 tf + 8 m)) with m = 10 +
    (90 n N) div L, where N counts the documents with a term, L all their terms
    and n the document's.

    Rows that share an item_id, null included, are one item with the terms of
    all; an item without terms has no rows; documents with a null id come last
    among equal scores; rows that repeat an id are ranked each. Items meet
    shards in blocks of about ``block``.
    """
    asked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    asked = durable(asked.mapInArrow(_query_terms, asked.select("item_id").schema.add("term", "string")).distinct(), "lexical-items")
    blocks = max(1, math.ceil(asked.select("item_id").distinct().count() / block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    wanted = asked.groupBy("block", "term").agg(F.collect_list(F.struct("item_id")).alias("items"))  # a block's items at most
    every = asked.select("block").distinct().select("block", F.lit(DOCUMENTS).alias("term"), F.array().cast(wanted.schema["items"].dataType).alias("items"))
    wanted = durable(wanted.unionByName(every), "lexical-terms")
    heads = index.filter(F.col("term") == DOCUMENTS).select("docs")
    n, total = heads.mapInArrow(_totals, "n_docs long, n_terms long").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    posted = index.join(wanted.select("term").distinct(), "term", "left_semi")
    df = posted.groupBy("term").agg(F.sum("df").alias("all_df"))
    rows = posted.join(df, "term").join(wanted, "term").select("block", "shard", "term", "docs", "counts", "ids", "all_df", "items")
    kind = asked.select("item_id").schema.add("doc_id", "long").add("score", "long")
    heaps = rows.groupBy("block", "shard").applyInArrow(lambda key, t: _search(key, t, n, total, k), kind)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return heaps.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
