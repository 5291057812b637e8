"""Toxic spans by a linear-chain conditional random field over words.

A chain is a sentence: words up to a full stop, exclamation or question mark or
line end. Two states need one number a word, so the forward and backward
passes run over log-odds, for all chains of a slice of texts at once. The
marginals give the offending offsets and, calibrated, the document's score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import fit_logistic, labelled_sample, logistic
from panelweave.llm.textbytes import Spans, slices, words

SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())]))),
])
BITS = 18
#: Chains up to which a step of all of them is not worth an array.
FEW = 8
PREFIXES = (4, 5, 6)
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOPS = np.zeros(256, bool)
_STOPS[[10, 13, 33, 46, 63]] = True
_SALTS = np.random.default_rng(5).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


@dataclass
class Tokens:
    """Words of one slice of texts."""

    doc: np.ndarray
    start: np.ndarray  # code points within the text
    end: np.ndarray
    chain: np.ndarray  # first word of each chain
    keys: np.ndarray  # one row a feature: word, prefixes, suffix, word before, word after

    @property
    def slots(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.array([((row * salt) >> np.uint64(64 - BITS)).astype(np.int32) for row, salt in zip(self.keys, _SALTS)])


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    start, end, doc = words(data, offsets, _SEPARATORS)
    begins = np.concatenate([(data & 0xC0) != 0x80, [True]])  # a byte that starts a code point
    index = np.concatenate([[0], np.cumsum(begins[:-1])])  # code points before a byte
    place = np.flatnonzero(begins)
    spans = Spans(data)
    point, after = index[start], index[end]
    word = spans.hash(start, end)
    rows = [word]
    for k in PREFIXES:
        rows.append(spans.hash(start, place[np.minimum(point + k, after)]))
    rows.append(spans.hash(place[np.maximum(after - 3, point)], end))
    new = np.ones(len(start), bool)
    if len(start) > 1:
        stops = np.concatenate([[0], np.cumsum(_STOPS[data])])
        new[1:] = (doc[1:] != doc[:-1]) | (stops[start[1:]] > stops[end[:-1]])
    before, behind = np.roll(word, 1), np.roll(word, -1)
    before[new] = np.uint64(1)
    behind[np.roll(new, -1)] = np.uint64(2)
    base = index[offsets[doc]] if len(doc) else point
    return Tokens(doc, point - base, after - base, np.flatnonzero(new), np.array([*rows, before, behind]).reshape(len(PREFIXES) + 4, -1))


class Chains:
    """Chains of a token table in order of falling length, to step through all at once."""

    def __init__(self, first: np.ndarray, total: int):
        length = np.diff(np.concatenate([first, [total]]))
        order = np.argsort(-length, kind="stable")
        self.first, self.length = first[order], length[order]
        longest = int(length.max()) if len(length) else 0
        self.active = np.searchsorted(-self.length, -np.arange(longest), "left")  # chains longer than t
        self.wide = max(1, int((self.active > FEW).sum()))  # steps that many chains take together

    def passes(self, u: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds alpha (with u) and beta per word; the ends of a few long chains go word by word."""
        e = np.exp(trans)
        (e00, e01), (e10, e11) = e.tolist()
        alpha, beta = u.copy(), np.zeros_like(u)
        longer = [(int(f), int(n)) for f, n in zip(self.first, self.length) if n > self.wide]
        for t in range(1, min(self.wide, len(self.active))):
            at = self.first[: self.active[t]] + t
            x = np.exp(np.clip(alpha[at - 1], -30, 30))
            alpha[at] += np.log((e01 + e11 * x) / (e00 + e10 * x))
        for f, n in longer:
            a, ends = float(alpha[f + self.wide - 1]), []
            for v in u[f + self.wide : f + n].tolist():
                x = math.exp(min(30.0, max(-30.0, a)))
                a = v + math.log((e01 + e11 * x) / (e00 + e10 * x))
                ends.append(a)
            alpha[f + self.wide : f + n] = ends
            b, ends = 0.0, []
            for v in u[f + self.wide : f + n][::-1].tolist():
                x = math.exp(min(30.0, max(-30.0, v + b)))
                b = math.log((e10 + e11 * x) / (e00 + e01 * x))
                ends.append(b)
            beta[f + self.wide - 1 : f + n - 1] = ends[::-1]
        for t in range(min(self.wide, len(self.active)) - 1, 0, -1):
            at = self.first[: self.active[t]] + t
            x = np.exp(np.clip(u[at] + beta[at], -30, 30))
            beta[at - 1] = np.log((e10 + e11 * x) / (e00 + e01 * x))
        return alpha, beta


@dataclass
class TaggerModel:
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    calibration: tuple[float, ...]

    def marginals(self, tok: Tokens) -> np.ndarray:
        u = np.full(tok.keys.shape[1], self.bias)
        for row in tok.slots:
            u += self.weights[row]
        alpha, beta = Chains(tok.chain, len(u)).passes(u, self.trans)
        return logistic(alpha + beta)


def _toxic_tokens(tok: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Label each word of a sample from the labels of its documents.

    Counts per word or prefix the toxic documents that have it less a multiple
    of the clean ones. Each toxic document is explained by its best one; what
    explains some document marks words of toxic documents. Copies of one toxic
    text so cannot turn its other words toxic: the commoner cause wins.
    """
    n_docs, rows = len(toxic), 1 + len(PREFIXES)
    ratio = 5.0 * max(1, toxic.sum()) / max(1, (~toxic).sum())
    best = np.zeros(n_docs)
    gains = np.zeros((rows, tok.keys.shape[1]))
    for r in range(rows):
        _, code = np.unique(tok.keys[r], return_inverse=True)
        pairs = np.unique(code.astype(np.int64) * n_docs + tok.doc)
        bad = toxic[pairs % n_docs]
        size = code.max() + 1 if len(code) else 0
        gain = np.bincount(pairs[bad] // n_docs, minlength=size) - ratio * np.bincount(pairs[~bad] // n_docs, minlength=size)
        gains[r] = gain[code]
    of = gains.max(0) if gains.size else np.zeros(0)
    np.maximum.at(best, tok.doc, of)
    floor = 2.0
    winner = (gains >= best[tok.doc] - 1e-9) & toxic[tok.doc] & (best[tok.doc] >= floor)
    label = np.zeros(tok.keys.shape[1], bool)
    for r in range(rows):
        wins = np.unique(tok.keys[r][winner[r]])
        label |= np.isin(tok.keys[r], wins) & toxic[tok.doc]
    return label


def _train(tok: Tokens, label: np.ndarray, rounds: int, ridge: float) -> TaggerModel:
    """Full-batch AdaGrad ascent of the conditional likelihood."""
    chain_of = np.zeros(len(label), int)
    chain_of[tok.chain[1:]] = 1
    chain_of = np.cumsum(chain_of)
    hit = np.bincount(chain_of, label, len(tok.chain)) > 0
    keep = hit | (np.arange(len(hit)) % max(1, int(len(hit) / (4 * hit.sum() + 2000))) == 0)
    mask = keep[chain_of] if len(label) else label
    slots, y = tok.slots[:, mask], label[mask].astype(float)
    first = np.flatnonzero(np.diff(np.concatenate([[-1], chain_of[mask]])))
    chains = Chains(first, len(y))
    follows = np.ones(len(y), bool)
    follows[first] = False
    nxt = np.flatnonzero(follows)
    w, bias, trans = np.zeros(1 << BITS), -3.0, np.zeros((2, 2))
    seen_w, seen_b, seen_t = np.full(1 << BITS, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    want = np.zeros((2, 2))
    if len(nxt):
        np.add.at(want, (y[nxt - 1].astype(int), y[nxt].astype(int)), 1)
    for _ in range(rounds if len(y) else 0):
        u = np.full(len(y), bias)
        for row in slots:
            u += w[row]
        alpha, beta = chains.passes(u, trans)
        off = y - logistic(alpha + beta)
        grad = sum(np.bincount(row, off, 1 << BITS) for row in slots) - ridge * w
        have = np.zeros((2, 2))
        if len(nxt):
            a, b = np.clip(alpha[nxt - 1], -30, 30), np.clip(u[nxt] + beta[nxt], -30, 30)
            z = np.exp(trans[None] + a[:, None, None] * np.array([[0], [1]]) + b[:, None, None] * np.array([0, 1]))
            have = (z / z.sum((1, 2), keepdims=True)).sum(0)
        step_t = want - have - 1.0 * trans
        seen_w += grad**2
        seen_b += off.sum() ** 2
        seen_t += step_t**2
        w += 0.5 * grad / np.sqrt(seen_w)
        bias += 0.2 * off.sum() / np.sqrt(seen_b)
        trans = trans + 0.2 * step_t / np.sqrt(seen_t)
    return TaggerModel(w.astype(np.float32), float(bias), trans, ())


def _documents(doc: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Per document: log-odds of its highest marginal, and log of 1 + the expected number of toxic words."""
    top = np.zeros(n)
    np.maximum.at(top, doc, p)
    total = np.bincount(doc, p, n)
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.column_stack([np.log(top / (1 - top)), np.log1p(total)])


def _table(texts) -> Tokens:
    """Words of all texts, slice by slice, so that what hashing takes does not grow with the sample."""
    parts, total = [], 0
    for at, data, offsets in slices(pa.array(list(texts), pa.large_string())):
        t = tokens(data, offsets)
        parts.append((t.doc + at, t.start, t.end, t.chain + total, t.keys))
        total += t.keys.shape[1]
    parts = parts or [tuple(getattr(tokens(np.empty(0, np.uint8), np.zeros(1, np.int64)), f) for f in ("doc", "start", "end", "chain", "keys"))]
    return Tokens(*(np.concatenate(x, axis=-1) for x in zip(*parts)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2500, most_chars: int = 20_000, rounds: int = 60, ridge: float = 0.02) -> TaggerModel:
    """Fit on at most ``per_class`` labelled documents of either class; learn is a condition on labels.

    Two thirds train the tagger, the rest the calibration, weighted to the
    shares of the classes in all labels that may be learnt from. Without rows
    of both classes every score is the share of toxic labels (0.5 without any).
    """
    sample = labelled_sample(docs, labels, "toxic", per_class, most_chars, learn)
    counts = {r["toxic"]: r["count"] for r in labels.filter(learn).groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    held = np.arange(len(sample)) % 3 == 2
    fit, cal = sample[~held], sample[held]
    tok = _table(fit.text)
    model = _train(tok, _toxic_tokens(tok, fit.label.to_numpy(bool)), rounds, ridge)
    model.calibration = (0.0, 0.0, float(np.log(share / (1 - share))))
    if len(set(cal.label)) == 2:
        tok = _table(cal.text)
        y = cal.label.to_numpy(float)
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        model.calibration = tuple(fit_logistic(_documents(tok.doc, model.marginals(tok), len(cal)), y, weight, ridge=0.1).tolist())
    return model


def _scored(batches, model):
    m = model.value
    slope, intercept = np.array(m.calibration[:-1]), m.calibration[-1]
    for batch in batches:
        for at, data, offsets in slices(batch.column(1), 1 << 22):
            n = len(offsets) - 1
            tok = tokens(data, offsets)
            p = m.marginals(tok)
            score = logistic(_documents(tok.doc, p, n) @ slope + intercept)
            hit = np.flatnonzero(p >= 0.5)
            ends = np.searchsorted(tok.doc[hit], np.arange(n + 1))
            spans = pa.StructArray.from_arrays([pa.array(tok.start[hit]), pa.array(tok.end[hit]), pa.array(p[hit])], names=["start", "end", "marginal"])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(score), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], names=SCORES.names)


def score_toxicity(docs: DataFrame, model: TaggerModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans) per row of docs; spans are words with a marginal of 0.5 or more.

    Offsets count code points, end exclusive. Whole texts count, of any length.
    A null, empty or wordless text has no spans and the score of a document
    whose words are all clean. Rows repeat as they come, a null doc_id stays
    null, other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 weights
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(partial(_scored, model=shared), SCORES)
