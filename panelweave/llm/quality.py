"""Compression classifier of quality: which dictionary, of good or of bad text, makes a document smaller."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import fit_logistic, labelled_sample, logistic

SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("difference", T.DoubleType()), T.StructField("score", T.DoubleType())])


@dataclass(frozen=True)
class CompressionModel:
    """Two zstandard dictionaries, the piece size they are used at, and the calibration."""

    good: bytes
    bad: bytes
    piece: int
    level: int
    coefficients: tuple[float, ...]

    def compressors(self) -> list:
        made = []
        for raw in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(dict_data=known, level=self.level, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made


def _pieces(text: str, size: int) -> list[bytes]:
    raw = text.encode("utf-8", "replace")
    return [raw[k : k + size] for k in range(0, len(raw), size)]


def difference(text: str, compressors: list, piece: int) -> float:
    """Compressed size of a whole text by the bad dictionary less that by the good one, over its size; 0 for an empty one.

    A piece starts from the dictionary alone, so a long text weighs its words
    like a short one and does not become its own dictionary.
    """
    pieces = _pieces(text, piece)
    good, bad = (sum(len(c.compress(p)) for p in pieces) for c in compressors)
    size = sum(map(len, pieces)) + 16  # short texts: what a frame costs shall not look like a difference
    return (bad - good) / size if pieces else 0.0


def _scores(texts, compressors: list, m: CompressionModel) -> tuple[np.ndarray, np.ndarray]:
    """(difference, score) of texts; null is empty."""
    x = np.array([difference(t.as_py() or "", compressors, m.piece) for t in texts], float)
    return x, logistic(100 * x * m.coefficients[0] + m.coefficients[1])


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2000, most_chars: int = 50_000, dictionary: int = 1 << 16, piece: int = 2048, level: int = 3) -> CompressionModel:
    """Build the dictionaries and the calibration from at most ``per_class`` labelled rows of either class.

    learn is a condition on the columns of labels. Two thirds of the sample
    become dictionaries, the rest calibrates; rows of either class weigh as
    the class does in all labels that may be learnt from. Without rows of both
    classes every score is the share of good labels (0.5 without labels).
    """
    sample = labelled_sample(docs, labels, "quality", per_class, most_chars, learn)
    counts = {r["quality"]: r["count"] for r in labels.filter(learn).groupBy("quality").count().collect() if r["quality"] in (0, 1)}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    held = np.arange(len(sample)) % 3 == 2
    books = []
    for k in (1, 0):
        pieces = [p for t in sample.text[(sample.label == k) & ~held] for p in _pieces(t, piece)]
        try:
            books.append(zstandard.train_dictionary(dictionary, pieces).as_bytes())
        except (zstandard.ZstdError, ValueError):  # too few samples to train on: their tail is the dictionary
            books.append(b"".join(pieces)[-dictionary:] or b" " * 8)
    model = CompressionModel(books[0], books[1], piece, level, (0.0, float(np.log(share / (1 - share)))))
    cal = sample[held]
    if len(set(cal.label)) < 2:
        return model
    both = model.compressors()
    x = 100 * np.array([[difference(t, both, piece)] for t in cal.text])
    y = cal.label.to_numpy(float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return CompressionModel(books[0], books[1], piece, level, tuple(fit_logistic(x, y, weight).tolist()))


def _scored(batches, model):
    both, m = None, model.value
    for batch in batches:
        both = both or m.compressors()
        x, z = _scores(batch.column(1), both, m)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(z)], names=SCORES.names)


def score_quality(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, difference, score) per row of docs; a higher score means label 1 likelier.

    Whole texts count, of any length. A null or empty text has difference 0
    and the score of the calibration there. Rows repeat as they come, a null
    doc_id stays null, other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(partial(_scored, model=shared), SCORES)


def _accepted(batches, model, least: float, text_at: int):
    both, m = None, model.value
    for batch in batches:
        both = both or m.compressors()
        yield batch.filter(pa.array(_scores(batch.column(text_at), both, m)[1] >= least))


def filter_quality(docs: DataFrame, model, least: float, text_col: str = "text") -> DataFrame:
    """Rows of docs whose score is ``least`` or more, unchanged; model is a broadcast one.

    Rows are scored and kept in one pass, so rows that share or lack a doc_id
    are judged each on its own text, as in score_quality().
    """
    return docs.mapInArrow(partial(_accepted, model=model, least=least, text_at=docs.columns.index(text_col)), docs.schema)
