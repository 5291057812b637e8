"""Ranked search against scoring every document, in plain Python."""

import math
import random
import re

import numpy as np
import pytest

from panelweave.llm import lexical_search
from panelweave.llm.lexical_search import wand

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    own = [(d, terms(t)) for d, t in docs]
    own = [(d, t) for d, t in own if t]
    n, total, df = len(own), sum(len(t) for _, t in own), {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, query in asked.items():
        found = []
        for d, t in own:
            m, score = 10 + 90 * len(t) * n // total, 0
            for x in query & set(t):
                tf = t.count(x)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found, key=lambda r: r[:3])[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("seed", range(30))
def test_wand(seed):
    """The heap of a shard equals full scoring, with ties, whatever the window."""
    rng = np.random.default_rng(seed)
    size, k = int(rng.integers(1, 400)), int(rng.integers(1, 12))
    ids = rng.permutation(size * 2)[:size].tolist()
    query, scores = [], np.zeros(size, np.int64)
    for _ in range(rng.integers(0, 9)):
        places = np.flatnonzero(rng.random(size) < rng.random() ** 2)
        impacts = rng.integers(0, 4, len(places)) * int(rng.integers(0, 5))
        query.append((places, impacts))
        scores[places] += impacts
    want = sorted((-int(s), ids[j]) for j, s in enumerate(scores) if s > 0)[:k]
    for window in (1, 7, 512):
        assert [(-s, ids[j]) for s, j in wand(query, ids, k, window)] == want


def test_wand_ties():
    """Equal scores go to the smallest ids, also where most documents have a common term only."""
    rare, common = np.arange(0, 100_000, 5_000), np.arange(100_000)
    heavy, light = np.full(len(rare), 1000), np.ones(len(common), np.int64)
    assert [j for _, j in wand([(rare, heavy), (common, light)], list(range(100_000)), 10)] == rare[:10].tolist()


def odd():
    rng = random.Random(5)
    words = ["Alpha", "beta", "Été", "été", "漢字", "x1", "zz", "the", "the", "the"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for k in range(150)]
    docs += [(200, None), (201, ""), (202, "!!! ..."), (None, "alpha beta 漢字"), (7, docs[7][1]), (7, "alpha"), (203, "the " * 50_000 + "beta"), (204, docs[3][1]), (205, docs[3][1])]
    items = [(1, "alpha BETA the"), (2, None), (3, "...") , (4, "nowhere"), (5, "été 漢字-x1 zz"), (None, "alpha"), (None, "beta"), (6, "zz"), (6, "zz"), (6, "x1")]
    return docs, items


def test_odd_rows(spark):
    docs, items = odd()
    d = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, term long, SHARD long").repartition(4)
    q = spark.createDataFrame([(a, b, 1, 2) for a, b in items], "item_id long, text string, doc_id long, score long")
    for most, block in ((100, 2), (1 << 25, 1024)):
        assert got(lexical_search.search(lexical_search.build_index(d, most_bytes=most), q, block=block)) == brute(docs, items)
    named = spark.createDataFrame([(f"i{a}", b) for a, b in items], "item_id string, text string")
    assert len(got(lexical_search.search(lexical_search.build_index(d), named))) > 20


def test_large_counts():
    """Numbers beyond 64 bits on the way."""
    sizes = np.array([1, 10**12], np.int64)
    assert lexical_search._margins(sizes, 10**9, 10**15).tolist() == [10, 10 + 90 * 10**12 * 10**9 // 10**15]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    texts = some.withColumnRenamed("item_id", "doc_id")
    for d, q in ((docs, items), (docs, some), (texts, items)):
        assert lexical_search.search(lexical_search.build_index(d), q).collect() == []


def test_query(spark, sf_dir):
    from panelweave.llm.queries import op13_lexical_search

    read = lambda name, a: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(a, "text").collect()]
    assert got(op13_lexical_search(spark, sf_dir)) == brute(read("documents", "doc_id"), read("benchmark", "item_id"))
