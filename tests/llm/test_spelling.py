"""Spelling variants against all pairs, in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from panelweave.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v)) if others else None
        form = best if best and words[best] >= 2 * n else None
        out[w] = [form, w, n, len(others), words[form] if form else None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("block", [1, 4, 64])
def test_all_pairs(spark, block):
    rng = random.Random(block)
    words = {}
    for _ in range(150):
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 9)))
        words[w] = rng.randrange(1, 60)
    stem = "prefixed" * 3
    words |= {stem + a + b: rng.randrange(1, 99) for a in "abcdefgh" for b in ("", "x", "y")}  # a block that has to be cut
    words |= {a + stem: rng.randrange(1, 99) for a in "abcdefgh"}
    words |= {"q" * 3000: 4, "q" * 2999: 9, "q" * 1500 + "r" + "q" * 1499: 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.spelling_variants(df, block=block)) == brute(words)


def test_counts(spark):
    """Runs that lose a code point, other alphabets, nulls, repeats and clashing columns."""
    rng = random.Random(3)
    vocabulary = ["Straße", "ÉTÉÉTÉ", "naïve", "abcdef", "AbcdeF", "x", "word×word", "the", "lengthy"]
    docs = [(k, " ".join(rng.choice(vocabulary) + rng.choice([",", "", "9", "ж"]) for _ in range(40))) for k in range(60)]
    docs += [(None, "orphan orphan orphan"), (61, None), (62, ""), (5, docs[5][1]), (5, docs[5][1]), (63, "z" * 200_000 + " tail")]
    rows = [(d, t, 1, 2) for d, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, WORD long").repartition(3)
    for one_in in (0, 2, 97):
        want = Counter()
        for doc, text in docs:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if one_in and h % one_in == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                want[run] += len(run) >= 5
        counted = {r["word"]: r["n"] for r in spelling.word_counts(df, one_in=one_in, most=7).collect()}
        assert counted == {w: n for w, n in want.items() if n >= 3}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.word_counts(df)).collect() == []


def test_chains(spark):
    """A chain of forms as long as doubling allows ends in one root."""
    words = {"aaaaa" + "b" * k: 3 * 2**k for k in range(14)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {r["root"] for r in spelling.spelling_variants(df).collect()} == {"aaaaa" + "b" * 13}


def test_query(spark, sf_dir):
    from panelweave.llm.queries import op12_spelling_variants

    want = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in want.items() if n >= 3 and len(w) >= 5}
    found = got(op12_spelling_variants(spark, sf_dir))
    assert {w: r[2] for w, r in found.items()} == words
    some = random.Random(1).sample(sorted(words), 60)
    for w in some:
        others = [v for v in words if near(w, v)]
        assert found[w][3] == len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        assert found[w][0] == (best if best and words[best] >= 2 * words[w] else None)
