"""Components against all pairs on small tables."""

import re

from panelweave.llm.near_dedup import half_bands, near_duplicates


def brute(rows, percent, width=5):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for (i, _), s in zip(rows, sets)), key=str)


def test_cases(spark):
    base = " ".join(f"w{k}" for k in range(120))
    rows = [
        (5, base), (3, base.upper()), (9, base + " tail"), (9, base + " tail"), (11, "x " + base + " y"), (2, None), (4, ""), (6, "  \t\n"),
        (7, "one two"), (8, "One  two"), (10, "one two three"), (None, base), (12, "é É ü a b c"), (13, "é É ü a b C"), (14, "é é ü a b c"), (20, " ".join(f"v{k % 7001}" for k in range(60000))), (21, " ".join(f"v{k % 7001}" for k in range(60001))),
    ]
    docs = spark.createDataFrame([(i, t, "z", 1, b"k") for i, t in rows], "doc_id long, text string, component_id string, n long, digest binary")
    got = sorted((tuple(r) for r in near_duplicates(docs, 0.85).collect()), key=str)
    assert got == brute(rows, 85)


def test_chain_of_edits(spark):
    """Neighbours are linked, ends are not: the component is still one."""
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(40):
        words[7 * k] = f"edit{k}"
        rows.append((100 - k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_duplicates(docs, 0.85).collect()), key=str) == brute(rows, 85)


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        assert sorted((tuple(r) for r in near_duplicates(docs, percent / 100).collect()), key=str) == brute(rows, percent)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_half_bands():
    for threshold in (0.8, 0.85, 0.9):
        m = half_bands(threshold, 3)
        assert (1 - (1 - threshold**3) ** m) ** 2 >= 0.9995
