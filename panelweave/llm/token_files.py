"""Token ids of a corpus in succinct files: a wavelet matrix per shard.

Documents are put in order of their ids over the whole table and encoded where
they have come to stand; a shard is a run of whole documents of about a given
number of tokens and becomes one compressed Parquet file with its bit-planes,
rank samples and document ends. Files are written by Spark, so that a task
that is run again leaves no second copy. Tokens can be read back whole, looked
up by position, counted and found without decoding a shard.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelweave.llm.textbytes import Spans, slices
from panelweave.llm.wavelet import WaveletMatrix
from panelweave.plans.storage import place

#: Columns of a shard: its number, which ascends with its documents; ids and ends (in tokens) of its documents; its wavelet matrix.
SHARD = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("shard", "n_tokens")]
    + [T.StructField(name, T.ArrayType(T.LongType())) for name in ("docs", "ends", "zeros")]
    + [T.StructField(name, T.ArrayType(T.BinaryType())) for name in ("planes", "samples")]
)
_ARROW = pa.schema([("shard", pa.int64()), ("n_tokens", pa.int64())] + [(c, pa.list_(pa.int64())) for c in ("docs", "ends", "zeros")] + [(c, pa.list_(pa.binary())) for c in ("planes", "samples")])
#: Positions and shards meet in ranges of two to this many tokens.
BIN = 22
#: A worker that remembers more pieces of texts than this, or more bytes of them, forgets all.
REMEMBERED, REMEMBERED_BYTES = 1_500_000, 1 << 25


def default_tokenizer() -> str:
    """Path of the tokenizer used where none is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoder(file: bytes) -> Encoder:
    return Encoder(file)


class Encoder:
    """Encodes whole texts by a tokenizer file, special tokens not added.

    A byte-level tokenizer without normaliser starts a new unit wherever white
    space follows something else, and wherever a stop follows a letter,
    whatever stands around. For such files the pieces between these borders
    are encoded once each and remembered; other files encode each text as it is.
    """

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.tokenizer, made = Tokenizer.from_str(file.decode()), json.loads(file)
        split = made.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        content = [np.frombuffer(a["content"].encode(), np.uint8) for a in made.get("added_tokens", ())]
        apart = all(not a.get("lstrip") and not a.get("rstrip") and not a.get("single_word") for a in made.get("added_tokens", ())) and not any(_borders(c).any() for c in content)
        self.by_pieces = bool(plain and apart and not any(made.get(x) for x in ("normalizer", "post_processor", "truncation", "padding")))
        #: An added token, which parts the pieces of a longer text for the tokenizer.
        self.mark = next(((a["content"], a["id"]) for a in made.get("added_tokens", ()) if a.get("special")), None)
        self._forget()

    def _forget(self) -> None:
        """Known pieces by number: their hashes in order and the numbers of these; where the bytes and the ids of each number end."""
        self.hashes, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.bytes, self.byte_ends = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.cumsum([len(x) for x in found], dtype=np.int64)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _encode(), for many short texts: some hundred go as one, with marks between them."""
        if self.mark is None or any(self.mark[0] in x for x in pieces):
            return self._encode(pieces)
        mark, number = self.mark
        ids, _ = self._encode([mark.join(pieces[k : k + 400]) + mark for k in range(0, len(pieces), 400)])
        at = np.flatnonzero(ids == number)
        return ids[ids != number], at - np.arange(len(at))

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Pieces get the next numbers; hashes ascend."""
        raw = data.tobytes()
        ids, stops = self._encode_pieces([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())])
        at = np.searchsorted(self.hashes, hashes)
        self.numbers = np.insert(self.numbers, at, np.arange(len(hashes)) + len(self.ends) - 1)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.bytes, self.byte_ends = np.concatenate([self.bytes, data[_spans(starts, ends)]]), np.concatenate([self.byte_ends, self.byte_ends[-1] + np.cumsum(ends - starts)])
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + stops])

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of pieces by hash, -1 where none is known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[spot] == hashes, self.numbers[spot], -1)

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Whether pieces are those that their numbers stand for, byte by byte: equal hashes prove nothing."""
        same = ends - starts == self.byte_ends[numbers + 1] - self.byte_ends[numbers]
        some = np.flatnonzero(same & (ends > starts))
        if len(some):
            equal = data[_spans(starts[some], ends[some])] == self.bytes[_spans(self.byte_ends[numbers[some]], self.byte_ends[numbers[some] + 1])]
            first = np.cumsum(ends[some] - starts[some]) - (ends[some] - starts[some])
            same[some] = np.logical_and.reduceat(equal, first)
        return same

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, ends of rows in them) of runs of texts, null as empty."""
        if not self.by_pieces:
            for k, text in enumerate(texts.to_pylist()):
                yield k, *self._encode([text or ""])
            return
        for row, data, offsets in slices(texts):
            borders = _borders(data)
            borders[offsets[:-1][offsets[:-1] < len(data)]] = True
            starts = np.flatnonzero(borders)
            ends = np.append(starts[1:], len(data))[: len(starts)]
            hashes, first, piece = np.unique(Spans(data, fold=False).hash(starts, ends), return_index=True, return_inverse=True)
            if len(self.hashes) > REMEMBERED or len(self.bytes) > REMEMBERED_BYTES:
                self._forget()
            one = starts[first], ends[first]
            number = self._numbers(hashes)
            new = np.flatnonzero(number < 0)
            number[new] = np.arange(len(new)) + len(self.ends) - 1
            if len(new):
                self._learn(data, one[0][new], one[1][new], hashes[new])
            number = number[piece]
            wrong = ~self._same(data, starts, ends, number)
            lengths = np.where(wrong, 0, self.ends[number + 1] - self.ends[number])
            begins = self.ends[number]
            ids, known = _spans(begins, begins + lengths), self.ids
            if wrong.any():  # pieces whose hash another piece has
                raw, at = data.tobytes(), np.flatnonzero(wrong)
                other, stops = self._encode([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
                known, lengths[at] = np.concatenate([known, other]), np.diff(stops, prepend=0)
                begins[at] = len(self.ids) + stops - lengths[at]
                ids = _spans(begins, begins + lengths)
            stops = np.concatenate([[0], np.cumsum(lengths)])
            yield row, known[ids], stops[np.searchsorted(starts, offsets[1:])]


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of spans, one after the other."""
    lengths = ends - starts
    stops = np.cumsum(lengths)
    return np.repeat(starts - stops + lengths, lengths) + np.arange(stops[-1] if len(stops) else 0)


_WHITE, _SOLID, _LETTER, _STOP = (np.zeros(256, bool) for _ in range(4))
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SOLID[33:127] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[[ord(c) for c in ".,;:!?"]] = True


def _borders(data: np.ndarray) -> np.ndarray:
    """Where a unit begins for sure: at white space after a visible character, at a stop after a letter; only ASCII and U+00C0 to U+00FF are judged."""
    out = np.zeros(len(data), bool)
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    out[1:] = (_WHITE[data[1:]] & (_SOLID[data[:-1]] | latin[:-1])) | (_STOP[data[1:]] & _LETTER[data[:-1]])
    return out


def _shard(number: int, docs: list, ids: list[np.ndarray], bits: int) -> pa.RecordBatch:
    ends = np.cumsum([len(x) for x in ids])
    m = WaveletMatrix.of(np.concatenate(ids), bits)
    row = {"shard": number, "n_tokens": m.n, "docs": docs, "ends": ends.tolist(), "zeros": m.zeros, "planes": [p.tobytes() for p in m.planes], "samples": [s.astype("<u4").tobytes() for s in m.samples]}
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def _write(batches, file, end_id: int, bits: int, most_tokens: int):
    """Shards of the documents of one partition, in their order."""
    number = TaskContext.get().partitionId() << 33
    docs, ids, size = [], [], 0
    encoder = None
    for batch in batches:
        encoder, names = encoder or _encoder(file.value), batch.column(0).to_pylist()
        for row, found, stops in encoder.encode(batch.column(1)):
            for doc, own in zip(names[row:], np.split(found, stops[:-1])):
                if docs and size + len(own) >= most_tokens:
                    yield _shard(number, docs, ids, bits)
                    number, docs, ids, size = number + 1, [], [], 0
                docs.append(doc)
                ids.append(np.append(own, np.uint32(end_id)))
                size += len(ids[-1])
    if docs:
        yield _shard(number, docs, ids, bits)


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2, most_tokens: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the ids of all documents, by ascending doc_id, and returns the folder of the files.

    tokenizer is the path of a file of the tokenizers library; end_id follows
    every document. A shard has at most ``most_tokens``, or one longer document.

    A null or empty text is a document of its end id alone. Rows that share an
    id, or whose id is null (they come first), are documents each, in an order
    that their texts fix; texts of any length are encoded whole; other columns
    are ignored; an empty table has no shards.
    """
    spark = docs.sparkSession
    path = path or place(spark, "token-shards")
    with open(tokenizer or default_tokenizer(), "rb") as f:
        raw = f.read()
    from tokenizers import Tokenizer

    bits = max(Tokenizer.from_str(raw.decode()).get_vocab_size(with_added_tokens=True) - 1, end_id).bit_length()
    file = spark.sparkContext.broadcast(raw)  # a vocabulary, under 2 MB
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # texts tell rows of one id apart, so that they spread over tasks
    order = ["doc_id", F.xxhash64("text")]
    shards = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_write, file=file, end_id=end_id, bits=bits, most_tokens=most_tokens), SHARD)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)
    return path


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    """The files of write_tokens()."""
    return spark.read.schema(SHARD).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(shard, start): tokens of all shards before; the one task that sums them has a row a shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], [np.frombuffer(p, np.uint8) for p in row["planes"]], [np.frombuffer(s, "<u4") for s in row["samples"]], row["zeros"])


def _rows(batches):
    """The shards of a task as dictionaries, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _read(batches, with_ids: bool):
    for row in _rows(batches):
        ids, ends = _matrix(row).ids().astype("<u4"), np.array(row["ends"])
        starts = np.concatenate([[0], ends[:-1]])
        raw = memoryview(ids.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
        out = {"shard": pa.array([row["shard"]] * len(ends), pa.int64()), "doc_id": pa.array(row["docs"], pa.int64()), "at": pa.array(starts), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(crc, pa.int64())}
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def read_documents(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), with ids if wanted, of each document, out of the files.

    start counts the tokens of all documents before, n_tokens the end id too;
    ids_crc32 is the unsigned crc32 of the ids as little-endian 32-bit integers.
    """
    kind = "shard long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = shards.mapInArrow(partial(_read, with_ids=with_ids), kind).join(shard_starts(shards), "shard")
    return found.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def _access(asked: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
    if not len(asked) or not len(shards):
        return pd.DataFrame({"position": [], "token": []}).astype("int64")
    at = (asked.position - asked.start).to_numpy()
    return pd.DataFrame({"position": asked.position, "token": _matrix(shards.iloc[0].to_dict()).access(at)})


def tokens_at(shards: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, token) for the rows of positions (position long, in tokens of the whole corpus) that lie within it; null and others have no row.

    Only the shards that are asked for are decoded, at the places asked for.
    """
    bin_of = lambda at: F.shiftright(at, BIN)
    begins = shard_starts(shards).join(shards.select("shard", "n_tokens"), "shard")
    begins = begins.withColumn("bin", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("start") + F.col("n_tokens") - 1))))
    asked = positions.select(F.col("position").cast("long").alias("position")).withColumn("bin", bin_of(F.col("position")))
    found = asked.join(begins, "bin").filter("position >= start and position < start + n_tokens").select("position", F.col("shard").alias("of"), "start")
    return found.groupBy("of").cogroup(shards.groupBy("shard")).applyInPandas(_access, "position long, token long")


def _counts(batches, tokens: list[int]):
    for row in _rows(batches):
        m = _matrix(row)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([m.count(t) for t in tokens], pa.int64())], names=["token", "n"])


def count_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of the tokens stands in the corpus, by rank alone; none for an empty corpus."""
    return shards.mapInArrow(partial(_counts, tokens=[int(t) for t in tokens]), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _places(batches, tokens: list[int]):
    for row in _rows(batches):
        m = _matrix(row)
        for t in tokens:
            at = m.places(t)
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(at), pa.int64()), pa.array([t] * len(at), pa.int64()), pa.array(at)], names=["shard", "token", "at"])


def find_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, position) of every occurrence of the tokens, by select."""
    found = shards.mapInArrow(partial(_places, tokens=[int(t) for t in tokens]), "shard long, token long, at long").join(shard_starts(shards), "shard")
    return found.select("token", (F.col("start") + F.col("at")).alias("position"))
