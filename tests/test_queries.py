"""Every query with SQL against DuckDB, and plans that scale."""

import json
import math
import os
import random
import re
from difflib import SequenceMatcher
from hashlib import sha1

import duckdb
import pytest
from pyspark.sql import functions as F

from panelweave.functions import clean as C
from panelweave.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def flat(value):
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return f"{float(value):.6g}" if type(value).__name__ == "Decimal" else str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(flat(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(flat(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def part_rows(duck):
    """Parts as records, as the queries take them."""
    out = []
    for k, name, brand, kind, size, price in duck.execute("select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part order by 1").fetchall():
        title = f"{name} & Lot {size} of the {brand} project"
        norm = re.sub("[^a-z0-9]+", " ", title.lower().replace("&", " and ")).strip()
        source = brand[6]
        tokens = {w for w in norm.split() if len(w) >= 3} - set(C.STOPWORDS)
        lots = {f"{m}:{i}" for m, i in re.findall(rf"\b({'|'.join(C.MARKERS)})\s*(\d+|[ivx]+|[a-z])\b", norm)}
        refs = [f"{source}:{k + 1}"] if k % 9 == 0 else []
        out.append(dict(k=k, key=f"{source}:{k}", source=source, norm=norm, tokens=tokens, lots=lots, block=(kind, size % 5), refs=refs, price=price, fund=brand[7:8], sector="energy" if size % 7 == 0 else "other", id=str(k)))
    return out


def candidate_pairs(parts):
    """{(left, right): (similarity, status)} by all pairs."""
    keys = {p["key"] for p in parts}
    out = {tuple(sorted((p["key"], r))): (1.0, "direct_reference") for p in parts for r in p["refs"] if r in keys}
    for i, a in enumerate(parts):
        for b in parts[i + 1 :]:
            both = len(a["tokens"] & b["tokens"])
            pair = tuple(sorted((a["key"], b["key"])))
            if both and a["block"] == b["block"] and a["source"] != b["source"] and pair not in out:
                score = max(both / len(a["tokens"] | b["tokens"]), 0.92 * both / min(len(a["tokens"]), len(b["tokens"])), SequenceMatcher(None, a["norm"], b["norm"]).ratio())
                if a["lots"] and b["lots"] and a["lots"] != b["lots"]:
                    score = min(score, 0.84)
                if round(score, 4) >= 0.75:
                    out[pair] = (round(score, 4), "auto_high_confidence" if round(score, 4) >= 0.85 else "needs_review")
    return out


def expanded(rows, keys):
    """{(left, right): (similarity, status)} of records, keys in load order, that pairs of classes and direct pairs stand for."""
    at, inside = {k: i for i, k in enumerate(keys)}, {}
    for r in rows:
        if r["status"] == "member":
            inside.setdefault(r["right_key"], []).append(r["left_key"])
    out = {}
    for r in rows:
        if r["status"] not in ("member", "direct_reference"):
            for a in inside[r["left_key"]]:
                out |= {tuple(sorted((a, b))): (r["similarity"], r["status"]) for b in inside[r["right_key"]] if at[a] < at[b]}
    return out | {(r["left_key"], r["right_key"]): (1.0, r["status"]) for r in rows if r["status"] == "direct_reference"}


def test_candidates_by_all_pairs(spark, sf_dir, duck):
    parts = part_rows(duck)
    got = {p: (pytest.approx(x, abs=1e-4), s) for p, (x, s) in expanded(QUERIES["match_candidates"](spark, sf_dir).collect(), [p["key"] for p in parts]).items()}
    want = candidate_pairs(parts)
    assert got == want and len({s for _, s in want.values()}) >= 2


def test_matched_records_by_hand(spark, sf_dir, duck):
    parts = part_rows(duck)
    pairs = candidate_pairs(parts)
    direct = [p for p, (_, s) in pairs.items() if s == "direct_reference"]
    scored = {p: x for p, (x, s) in pairs.items() if s != "direct_reference"}
    met = {x for p in direct for x in p}
    best = {}
    for p in parts:
        mine = [(x, a if b == p["key"] else b) for (a, b), x in scored.items() if p["key"] in (a, b)]
        top = [o for x, o in mine if x == max(m for m, _ in mine)]
        best[p["key"]] = (max((m for m, _ in mine), default=0.0), top[0] if len(top) == 1 else None, len(mine))
    auto = [(k, o) for k, (x, o, _) in best.items() if o and x >= 0.85 and best[o][1] == k and k < o and not {k, o} & met]
    root = roots(direct + auto)
    members = {}
    for x, r in root.items():
        members.setdefault(r, set()).add(x)
    want = {}
    for p in parts:
        k, (top, _, n) = p["key"], best[p["key"]]
        ident = f"PM-{sha1('|'.join(sorted(members[root[k]])).encode()).hexdigest()[:14].upper()}" if k in root else f"SRC-{sha1(k.encode()).hexdigest()[:14].upper()}"
        status = "direct_reference" if k in met else "auto_high_confidence" if k in root else "needs_review" if n else "unmatched"
        want[k] = (ident, status, pytest.approx(1.0 if k in met else top, abs=1e-4), n)
    got = {r["record_key"]: (r["project_match_id"], r["match_status"], r["match_confidence"], r["candidate_count"]) for r in QUERIES["matched_records"](spark, sf_dir).collect()}
    assert got == want and {"direct_reference", "unmatched"} <= {s for _, s, _, _ in want.values()}


def queued(rows):
    """{(left, right): row} of records that pairs of classes of copies stand for, with the similarity of their order."""
    inside, pairs = {}, [r for r in rows if r["kind"] == "pair"]
    for r in rows:
        if r["kind"] == "member":
            inside.setdefault(r["right_key"], []).append(r)
    out = {}
    for r in pairs:
        mine = {(a["left_key"], b["left_key"]): (a["ordinal"], b["ordinal"]) for a in inside[r["left_key"]] for b in inside[r["right_key"]] if a["project_match_id"] != b["project_match_id"]}
        mine = {p: r.asDict() | {"similarity": r["left_first"] if i < j else r["right_first"]} for p, (i, j) in mine.items() if i != j}
        mine = {p: m for p, m in mine.items() if m["similarity"] is not None}
        assert mine and not mine.keys() & out.keys()
        out |= mine
    return out


def test_recommendations_follow_the_rules(spark, sf_dir, duck):
    parts = {p["key"]: p for p in part_rows(duck)}
    rows = QUERIES["review_recommendations"](spark, sf_dir).collect()
    group = {r["left_key"]: r["project_match_id"] for r in rows if r["kind"] == "member"}
    got = queued(rows)
    pairs = {p: x for p, (x, s) in candidate_pairs(list(parts.values())).items() if s != "direct_reference" and group[p[0]] != group[p[1]]}
    assert {p: r["similarity"] for p, r in got.items()} == {p: pytest.approx(x, abs=1e-4) for p, x in pairs.items()} and pairs
    for (left, right), r in got.items():
        a, b = parts[left], parts[right]
        ratio = round(a["price"] / b["price"], 6)
        fits, agrees = a["fund"] == b["fund"] and a["sector"] == b["sector"], 0.98 <= ratio <= 1.02
        if a["lots"] and b["lots"] and a["lots"] != b["lots"]:
            want = "conflicting_project_component_identifier"
        elif a["id"] == b["id"] and fits and agrees:
            want = "same_source_identifier_and_amount"
        elif a["norm"] == b["norm"] and fits and agrees:
            want = "exact_normalized_title_and_compatible_fields"
        else:
            want = "sector_conflict_requires_context" if a["sector"] != b["sector"] else "manual_evidence_required"
        assert r["rule_id"] == want and r["amount_ratio"] == pytest.approx(ratio, abs=2e-6)


def copied_records(spark, copies):
    """Forty records of one block, repeated in load order; some share an id with another source, lack an amount, or name a record of another source."""
    rng, rows = random.Random(8), []
    base = [(rng.choice("123"), f"{rng.choice(['red', 'blue'])} {rng.choice(['dam', 'road', 'rail link'])} & Lot {rng.randrange(1, 3)} works", rng.choice([None, 100.0, 101.0, 300.0]), rng.choice(["loan", "grant"])) for _ in range(40)]
    for c in range(copies):
        for k, (source, title, amount, fund) in enumerate(base):
            n = c * 40 + k
            refs = [f"{base[k + 1][0]}:{n + 1}"] if k % 10 == 0 else [f"{base[k - 1][0]}:{(c + 1) % copies * 40 + k - 1}"] if k % 10 == 3 else []
            rows.append((f"{source}:{n}", source, "same" if k in (5, 6, 7, 8) else str(n), title, "E", 1, n, amount, "usd", "c", fund, "other", refs))
    return spark.createDataFrame(rows, "record_key string, source string, record_id string, title string, entity string, period int, ordinal long, amount double, price_basis string, amount_measure string, fund string, sector string, refs array<string>")


def test_recommendations_of_copies(spark):
    """Pairs of classes stand for just the pairs of records that a queue of records holds, and do not grow with copies."""
    from panelweave.operators import matching, review

    sizes = []
    for copies in (2, 4):
        recs = copied_records(spark, copies)
        want = {(r["left_key"], r["right_key"]): r.asDict() for r in review.recommend(review.review_queue(*matching.apply_matching(recs)[::-1])).collect()}
        matched, links, members, _ = matching.match_by_classes(recs)
        copied = review.copies(members, matched, review.shared_ids(matched))
        rows = review.with_members(review.recommend(review.class_queue(links, copied, matched)), copied).collect()
        got = queued(rows)
        told = ("similarity", "review_hint", "amount_ratio", "rule_id", "review_decision", "confidence", "auto_apply", "left_fund", "right_amount")
        assert {p: [r[c] for c in told] for p, r in got.items()} == {p: [r[c] for c in told] for p, r in want.items()}
        assert len({r["rule_id"] for r in want.values()}) == 3 and len(got) > 2 * len([r for r in rows if r["kind"] == "pair"])
        sizes.append((len(got), len([r for r in rows if r["kind"] == "pair"])))
    assert sizes[1][0] > 3 * sizes[0][0] and sizes[1][1] <= sizes[0][1]


def test_batch_review_decides_every_pair_once(spark, sf_dir):
    rows = QUERIES["batch_reviewed"](spark, sf_dir).filter("kind = 'pair'").collect()
    ids = [r["candidate_id"] for r in rows]
    assert ids and len(ids) == len(set(ids))
    differs = re.compile("conflicting|distinct_related|reviewed_difference|separate")
    assert all(r["review_decision"] == ("different_project" if differs.match(r["rule_id"]) else "same_project") for r in rows)


def test_payload(spark, sf_dir, duck):
    want = dict(duck.execute("select n_name, count(*) from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1").fetchall())
    got = {r["entity"]: json.loads(r["payload"]) for r in QUERIES["dashboard_payload"](spark, sf_dir).collect()}
    assert {e: p["records"] for e, p in got.items()} == want
    assert all(sum(p["by_source"].values()) == sum(p["by_period"].values()) == p["records"] and len(p["by_source"]) == p["source_count"] for p in got.values())


def test_whole_build(spark, sf_dir, tmp_path):
    """Raw files of forty parts to statistics, and the checks of all of it; a decision joins two records."""
    from panelweave.plans import build, source_queries

    spark.read.parquet(f"{sf_dir}/part.parquet").limit(40).write.parquet(str(tmp_path / "part.parquet"))
    folder = source_queries.raw_folder(spark, str(tmp_path))
    built = build.build(spark, folder)
    found = {r["check"]: r["failures"] for r in build.check(built).collect()}
    assert len(found) == 21 and not any(found.values())
    records = built["records"].count()
    assert records == built["entities"].agg(F.sum("member_count")).first()[0] and records > 9 * 40
    pair = built["queue"].orderBy("candidate_id").first()
    said = spark.createDataFrame([(pair["candidate_id"], "same_project")], build.DECISIONS)
    again = build.build(spark, folder, said)
    ids = {r["record_key"]: (r["project_match_id"], r["match_status"]) for r in again["records"].collect()}
    assert ids[pair["left_key"]] == ids[pair["right_key"]] and ids[pair["left_key"]][1] == "human_confirmed"


def test_published_tables_are_sorted(spark, sf_dir):
    from panelweave.operators import publish

    rows = [("b", -0.5, 2), ("a", 0.5, 1), ("c", None, 3), ("a", 0.5, 0)]
    df = spark.createDataFrame(rows, "left_metric string, spearman_rho double, right_metric int").withColumn("scope", F.lit("s"))
    got = [(r["left_metric"], r["right_metric"]) for r in publish.in_order(df, "correlations").collect()]
    assert got == [("a", 0), ("a", 1), ("b", 2), ("c", 3)]
    numbered = publish.numbered(spark.range(1000).repartition(7), F.col("id").desc()).collect()
    assert sorted((r["position"], r["id"]) for r in numbered) == [(k + 1, 999 - k) for k in range(1000)]
    assert publish.numbered(spark.range(0), "id").collect() == []


def test_long_series_breaks(spark):
    """2,000 values: the recurrence is quadratic, not cubic."""
    rng = random.Random(2)
    rows = [("s", k, (1.0 if k < 700 else 5.0 if k < 1500 else 2.0) + rng.random() / 10) for k in range(2000)]
    from panelweave.operators import breaks

    got = breaks.mean_breaks(spark.createDataFrame(rows, "series string, period int, value double")).first()
    assert got["break_indices"][:1] == [700] and 1500 in got["break_indices"]


def test_kendall_of_many_points(spark):
    """Against a count over all pairs, with ties on both sides."""
    from panelweave.operators import stats

    rng = random.Random(6)
    points = [(g, str(k), float(rng.randrange(40)), float(rng.randrange(60)), 1) for g in ("p", "q") for k in range(300)]
    got = {r["g"]: r["kendall_tau_b"] for r in stats.kendall(spark.createDataFrame(points, "g string, point string, x double, y double, shared int"), ["g"]).collect()}
    for g in ("p", "q"):
        mine = [(x, y) for h, _, x, y, _ in points if h == g]
        c = d = tx = ty = 0
        for i, (a, b) in enumerate(mine):
            for x, y in mine[:i]:
                s = (a - x) * (b - y)
                c, d, tx, ty = c + (s > 0), d + (s < 0), tx + (a == x and b != y), ty + (b == y and a != x)
        assert got[g] == pytest.approx((c - d) / math.sqrt((c + d + tx) * (c + d + ty)), abs=1e-6)


def roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_of_every_row(spark, sf_dir, duck):
    parts, lines = duck.execute("select p_partkey from part").fetchall(), duck.execute("select l_partkey, l_suppkey from lineitem").fetchall()
    want = roots([(f"k{k:09}", f"k{k + 1:09}") for (k,) in parts] + [(f"P{p}", f"S{s}") for p, s in lines])
    got = {r["node"]: r["component"] for r in QUERIES["components_all"](spark, sf_dir).collect()}
    assert got == want
    # the chain of all parts is one component
    assert sum(c == got[f"k{parts[0][0]:09}"] for c in got.values()) == len(parts) + 1


def test_reviews_of_every_part(spark, sf_dir, duck):
    parts = duck.execute("select p_partkey, p_name, p_brand from part").fetchall()
    root = roots([(f"k{k:09}", f"hub|{n}|{b}") for k, n, b in parts])
    first = {}
    for k, n, _ in sorted(parts):
        first.setdefault(n, k)
    pairs = {(f"k{a:09}", f"k{b:09}") for k, n, _ in parts for a, b in ((k, k + 2), (first[n], k)) if a < b}
    want = {(a, b, "same_project" if root.get(a, a) == root.get(b, b) else "different_project") for a, b in pairs}
    got = QUERIES["completed_reviews"](spark, sf_dir).collect()
    assert {(r["left_key"], r["right_key"], r["review_decision"]) for r in got} == want and len(got) == len(want) and len({x[2] for x in want}) == 2


def test_all_sources_and_pairs(spark, sf_dir, duck):
    real = {x for (x,) in duck.execute("select distinct o_orderpriority from orders").fetchall()}
    assert {r["source"] for r in QUERIES["source_quality"](spark, sf_dir).collect()} == real | {"6-NONE"}
    assert len(QUERIES["panel_fund_columns"](spark, sf_dir).columns) == 1 + len(real) * duck.execute("select count(distinct c_mktsegment) from customer").fetchone()[0]


def test_raw_files_are_written_by_many_tasks(spark, sf_dir):
    """Part files in order of keys, so that as many tasks read them back."""
    import glob

    from panelweave.plans import source_queries

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = source_queries.raw_folder(spark, sf_dir, ("cancellation_africa_clean.csv",))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(glob.glob(f"{folder.removeprefix('file:')}/cancellation_africa_clean.csv/part-*.csv"))
    keys = [[int(r["Record_ID"]) for r in spark.read.csv(p, header=True).select("Record_ID").collect()] for p in parts]
    assert len([k for k in keys if k]) > 1
    flat = [x for k in keys for x in k]
    assert flat == sorted(flat)


def test_wide_panel_reads_records_once(spark, sf_dir):
    """What it counts and adds comes from the written records, not from the raw files again."""
    read = QUERIES["built_wide_panel"](spark, sf_dir).inputFiles()
    assert any("/records-" in f for f in read) and not any("aiddata_africa_clean" in f for f in read)
