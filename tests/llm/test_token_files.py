"""Token files against whole texts encoded one by one, and the wavelet matrix against plain arrays."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelweave.llm import token_files
from panelweave.llm.wavelet import WaveletMatrix


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.default_tokenizer())


@pytest.mark.parametrize("n, bits, top", [(0, 3, 8), (1, 1, 2), (511, 4, 16), (512, 4, 3), (5000, 16, 50257), (70000, 16, 40)])
def test_wavelet_matrix(n, bits, top):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, top, n) * rng.integers(0, 2, n)).astype(np.uint32)
    m = WaveletMatrix.of(ids, bits)
    assert (m.ids() == ids).all()
    at = rng.integers(0, max(n, 1), 300 if n else 0)
    assert (m.access(at) == ids[at]).all()
    for t in [0, 1, top - 1, *rng.integers(0, top, 5).tolist(), (1 << bits) + 1]:
        assert m.count(t) == (ids == t).sum() and (m.places(t, step=1000) == np.flatnonzero(ids == t)).all()
        assert m.count(t, n // 3, n // 2) == (ids[n // 3 : n // 2] == t).sum()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "Wort", "don't", "'s", "12", ".", "--", "é", "漢字", "<|endoftext|>", "😀", "́"]), max_size=14).map("".join))
def test_pieces_are_whole_texts(text):
    e = token_files._encoder(open(token_files.default_tokenizer(), "rb").read())
    assert e.by_pieces
    texts = [text, "", None, "a " + text]
    assert ids_of(e, texts) == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def ids_of(encoder, texts):
    out = []
    for row, ids, stops in encoder.encode(pa.array(texts, pa.string())):
        assert row == len(out)
        out += [x.tolist() for x in np.split(ids, stops[:-1])]
    return out


def test_forgetting(monkeypatch, tokenizer):
    monkeypatch.setattr(token_files, "REMEMBERED", 10)
    e = token_files.Encoder(open(token_files.default_tokenizer(), "rb").read())
    for k in range(9):
        text = f"more words {k} than it  remembers, for ever {k}"
        assert ids_of(e, [text]) == [tokenizer.encode(text).ids]
        assert len(e.hashes) < 25


def test_equal_hashes(monkeypatch, tokenizer):
    """Pieces are told apart by their bytes where their hashes are equal."""
    monkeypatch.setattr(token_files.Spans, "hash", lambda self, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    e = token_files.Encoder(open(token_files.default_tokenizer(), "rb").read())
    for texts in (["one two three four", "", "five, six. seven!"], ["two one eleven", None, "a bb ccc dddd"]):
        assert ids_of(e, texts) == [tokenizer.encode(t or "").ids for t in texts]


def test_other_tokenizers():
    """A file whose units may cross spaces encodes texts as they are."""
    import public_tokenizers

    e = token_files.Encoder(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    texts = ["Some text", "", "more  text here"]
    assert not e.by_pieces and ids_of(e, texts) == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def digest(tokenizer, docs):
    """Brute force: rows in order of id, null first."""
    out, start = [], 0
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_every_document(spark, sf_dir, tokenizer):
    from panelweave.llm.queries import op11_token_files

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op11_token_files(spark, sf_dir)) == digest(tokenizer, docs)


def test_odd_rows_and_lookups(spark, tokenizer):
    docs = [(7, "# a # b"), (3, None), (5, ""), (None, "no id"), (9, "lorem ipsum " * 30000), (4, "x" * 5000), (6, "same"), (8, "same"), (10, "<|endoftext|> end  of   text\n\n!")]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, start long, SHARD string")
    for most in (3, 1 << 22):
        shards = token_files.open_shards(spark, token_files.write_tokens(df.repartition(3), most_tokens=most))
        want = digest(tokenizer, docs)
        found = token_files.read_documents(shards, with_ids=True)
        assert got(found) == want
        assert {r["doc_id"]: r["ids"] for r in found.collect()} == {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in docs}
        every = [i for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)) for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]]
        ask = [0, 1, 5, len(every) - 1, len(every), -1, 17, 17, None]
        asked = spark.createDataFrame([(a,) for a in ask], "position long")
        assert sorted(tuple(r) for r in token_files.tokens_at(shards, asked).collect()) == sorted((a, every[a]) for a in ask if a is not None and 0 <= a < len(every))
        assert {tuple(r) for r in token_files.count_tokens(shards, [2, 87, 49999]).collect()} == {(t, every.count(t)) for t in (2, 87, 49999)}
        assert sorted(tuple(r) for r in token_files.find_tokens(shards, [2, 87]).collect()) == sorted((t, k) for k, t in enumerate(every) if t in (2, 87))


def test_rows_that_share_an_id(spark, tokenizer):
    docs = [(1, "b c"), (1, "a"), (1, "a"), (2, "end")]
    found = got(token_files.read_documents(token_files.open_shards(spark, token_files.write_tokens(spark.createDataFrame(docs, "doc_id long, text string")))))
    assert sorted(r[2] for r in found) == [2, 2, 2, 3] and found[-1][0] == 2 and [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found[:-1])]).tolist()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    shards = token_files.open_shards(spark, token_files.write_tokens(df))
    assert token_files.read_documents(shards).collect() == [] and token_files.count_tokens(shards, [1]).collect() == []
