"""Token counts per section, by offset mapping.

A document is encoded once, whole: encoding sections apart would split tokens
at their borders and count others. Token spans, as running sums of token
lengths, are joined to section spans as intervals; a token that crosses a
border is allocated by an explicit rule.
"""

from __future__ import annotations

import base64
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: To which section a token goes that crosses a border: where it starts, where it ends, or which has most of its bytes (ties: the earlier).
RULES = ("start", "end", "most")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """Path of the rank file used where none is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    lengths = np.zeros(max(merges.values()) + 1, np.int64)
    for token, number in merges.items():
        lengths[number] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={}), lengths


def allocate(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, rule: str) -> np.ndarray:
    """Index of the section of each token; borders are the sections' starts, in bytes, the first 0."""
    first = np.searchsorted(borders, starts, "right") - 1
    last = np.searchsorted(borders, np.maximum(ends - 1, starts), "right") - 1
    if rule == "start":
        return first
    if rule == "end":
        return last
    out = first.copy()
    for k in np.flatnonzero(last > first).tolist():
        cuts = np.concatenate([[starts[k]], borders[first[k] + 1 : last[k] + 1], [ends[k]]])
        out[k] = first[k] + int(np.argmax(np.diff(cuts)))
    return out


def _count(batches, ranks, pattern: str, rule: str):
    encode, lengths = None, None
    for batch in batches:
        if encode is None:
            encode, lengths = _encoder(ranks.value, pattern)
        rows: list[list] = [[], [], [], [], [], []]
        docs = batch.column(0).to_pylist()
        for k, text in enumerate(batch.column(1)):
            raw = (text.as_py() or "").encode("utf-8", "replace")
            data = np.frombuffer(raw, np.uint8)
            borders = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
            if len(borders) > 1 and borders[-1] == len(data):
                borders = borders[:-1]  # a final line end belongs to the line before
            ids = encode.encode_to_numpy(raw.decode(), disallowed_special=())
            ends = np.cumsum(lengths[ids])
            section = allocate(ends - lengths[ids], ends, borders, rule)
            crossing = np.searchsorted(borders, np.maximum(ends - 1, 0), "right") - np.searchsorted(borders, ends - lengths[ids], "right") > 0
            n = len(borders)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            stops = np.concatenate([borders[1:], [len(data)]])
            rows[0] += [docs[k]] * n
            for col, values in zip(rows[1:], (np.arange(n), points[borders], points[stops], np.bincount(section, minlength=n), np.bincount(section, crossing, n).astype(np.int64))):
                col.append(values)
        arrays = [pa.array(rows[0], pa.int64())] + [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in rows[1:]]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])


def section_tokens(docs: DataFrame, vocabulary: str | None = None, rule: str = "start", pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing): tokens of each line of each document.

    Sections are the lines of a text, each with its line end; start and end
    count code points, end exclusive. n_tokens sums to the number of tokens of
    the whole text under every rule; n_crossing counts those allocated here
    that touch another section too. vocabulary is the path of a rank file.

    A null or empty text is one empty section of no tokens. A null doc_id stays
    null, repeated rows each give their sections, texts of any length are
    encoded whole, strings of special tokens are ordinary text, other columns
    are ignored, and an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(vocabulary or default_vocabulary(), "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary, under 1 MB
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(partial(_count, ranks=ranks, pattern=pattern, rule=rule), "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")
