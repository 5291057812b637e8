"""Cleaning, title similarity, matching and review on hand-made rows."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from panelweave.functions import clean as C
from panelweave.functions import evidence as E
from panelweave.operators import matching, review
from panelweave.operators.graph import connected_components

RECORD = "record_key string, source string, record_id string, title string, entity string, period int, ordinal long, refs array<string>, amount double, price_basis string, amount_measure string, fund string, sector string"


def record(key, title, ordinal, refs=(), entity="KEN", period=2010, amount=None, sector="energy"):
    source, ident = key.split(":")
    return (key, source, ident, title, entity, period, ordinal, list(refs), amount, "nominal_usd", "commitment", "loan", sector)


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_numbers(spark):
    cells = ["1,234.5", " 5 ", "", "NA", "tbd", "inf", "1d", "1_000", "1e3", "(100)", None, "."]
    assert values(spark, cells, "x string", C.parse_number(F.col("x"))) == [1234.5, 5.0, None, None, None, None, None, None, 1000.0, None, None, None]


def test_years(spark):
    assert values(spark, ["2012", "FY2012/13", "x12019", "1899", "", None], "x string", C.parse_year(F.col("x"))) == [2012, 2012, 2019, None, None, None]


def test_normalisers(spark):
    cells = ["Côte d'Ivoire", "A & B", "水电 Plant", None]
    df = spark.createDataFrame([(c,) for c in cells], "x string")
    assert [r[0] for r in df.select(C.norm_text("x")).collect()] == ["co te d ivoire", "a and b", "水电 plant", ""]
    assert [r[0] for r in df.select(C.norm_name("x")).collect()] == ["cotedivoire", "aandb", "水电plant", ""]
    assert [r[0] for r in df.select(C.normalized_title("x")).collect()] == ["cote d ivoire", "a and b", "plant", ""]


def test_labels(spark):
    assert values(spark, ["loan for", "grant credit", "equity", "x"], "x string", C.fund_type(F.col("x"))) == ["loan", "grant", "equity", "unspecified"]
    assert values(spark, ["district", "11230", "", "zebra"], "x string", C.harmonize_sector(F.col("x"), F.lit(""))) == ["communications", "energy", "unspecified", "other"]
    assert values(spark, ["district", "road works"], "x string", C.harmonize_sector(F.col("x"), F.lit(""), whole_words=True)) == ["other", "transport"]
    pairs = spark.createDataFrame([("codf", "cla"), ("aiddata", "chapo"), ("aiddata", "cla")], "a string, b string")
    assert [r[0] for r in pairs.select(C.lineage(F.col("a"), F.col("b"))).collect()] == ["likely_shared_lineage", "documented_cross_reference_overlap", "distinct_source_comparison"]


def scores(spark, left, right):
    rows = [record("a:1", left, 1), record("b:1", right, 2)]
    titles = matching.titled(spark.createDataFrame(rows, RECORD))
    return [r["similarity"] for r in matching.similarity(matching.blocked_pairs(titles), titles).collect()]


def test_similarity(spark):
    assert scores(spark, "Rural Road Upgrade", "rural road upgrade")[0] >= 0.85
    assert 0.75 <= scores(spark, "Rural Road Upgrade Lot 1", "Rural Road Upgrade Lot 2")[0] < 0.85
    assert scores(spark, "Rural Road", "Solar Plant") == []


def test_ratio_is_matched_where_it_can_reach_the_least(spark):
    """No ratio at or above the least is lost; those given are the matcher's own."""
    rng = random.Random(5)
    texts = ["", "a", "abcd", "x" * 300, *("".join(rng.choice("abc de") for _ in range(rng.randrange(1, 70))) for _ in range(60)), "y" * 250 + "abcab"]
    rows = [(a, b, floor) for a in texts for b in texts for floor in (0.0, 0.6, 0.75)] + [(None, "a", 0.0), ("a", None, 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, least double")
    skipped = 0
    for r in df.select("a", "b", "least", matching.sequence_ratio("a", "b", "least").alias("r")).collect():
        if r["a"] is None or r["b"] is None:
            assert r["r"] is None
            continue
        true = SequenceMatcher(None, r["a"], r["b"]).ratio()
        skipped += r["r"] is None
        assert true < r["least"] if r["r"] is None else r["r"] == true
    assert skipped > len(rows) // 4


def test_ratios_of_a_batch_are_the_matchers_own():
    rng = random.Random(3)
    left, right = (["".join(rng.choice("abc de水é"[: 2 + k % 7]) for _ in range(rng.randrange(0, 199))) for k in range(300)] for _ in range(2))
    left += right[:40]
    right += right[40:80]
    want = [sum(x.size for x in SequenceMatcher(None, a, b).get_matching_blocks()) for a, b in zip(left, right)]
    assert list(matching.matched_characters(left, right)) == want


def test_copies_make_no_pairs(spark):
    """Thirty copies of three titles: a candidate row a pair of classes and order, and counts of records as all pairs of records give them."""
    titles = {"a": "Rural Road Upgrade in Turkana", "b": "Upgrade of Rural Roads Turkana", "c": "Rural Road Upgrade Turkana Lot 2"}
    rng = random.Random(7)
    order = [(s, k) for s in titles for k in range(30)]
    rng.shuffle(order)
    rows = [record(f"{s}:{k}", titles[s], n, ["b:3"] if (s, k) == ("a", 2) else ()) for n, (s, k) in enumerate(order)]
    df = spark.createDataFrame(rows, RECORD)
    direct = matching.direct_pairs(df)
    rows_ = matching.class_candidates(df, direct).collect()
    assert sum(r["status"] not in ("member", "direct_reference") for r in rows_) <= 6 and sum(r["status"] == "member" for r in rows_) == 90
    assert matching.class_overlaps(df).filter("kind = 'pair'").count() == 3
    got, cand = matching.apply_matching(df)
    pairs = [r for r in cand.collect() if r["status"] != "direct_reference"]
    tally = {}
    for r in pairs:
        for k in (r["left_key"], r["right_key"]):
            n, top = tally.get(k, (0, 0.0))
            tally[k] = (n + 1, max(top, r["similarity"]))
    assert len(pairs) >= 900
    for r in got.collect():
        n, top = tally.get(r["record_key"], (0, 0.0))
        assert r["candidate_count"] == n and (r["match_status"] == "direct_reference" or r["match_confidence"] == top)


def test_direct_pairs_are_not_bridged(spark):
    title = "Hydropower Station Expansion"
    rows = [record("a:1", title, 1, ["b:1"]), record("b:1", title, 2), record("a:2", title, 3, ["b:2"]), record("b:2", title, 4), record("c:1", "Lonely Bridge", 5), record("d:1", None, 6, entity=None, period=None)]
    got, cand = matching.apply_matching(spark.createDataFrame(rows, RECORD))
    ids = {r["record_key"]: (r["project_match_id"], r["match_status"]) for r in got.collect()}
    assert ids["a:1"] == ids["b:1"] and ids["a:2"] == ids["b:2"] and ids["a:1"] != ids["a:2"]
    assert ids["a:1"][1] == "direct_reference" and ids["c:1"][1] == ids["d:1"][1] == "unmatched"
    assert cand.filter("status = 'direct_reference'").count() == 2


def test_automatic_and_reviewed_links(spark):
    rows = [record("a:1", "Coastal Railway Line", 1), record("b:1", "Coastal Railway Line", 2), record("a:2", "Port Crane Supply Lot 1", 3), record("b:2", "Port Crane Supply Lot 2", 4, sector="transport")]
    got, cand = matching.apply_matching(spark.createDataFrame(rows, RECORD))
    status = {r["record_key"]: r["match_status"] for r in got.collect()}
    assert status == {"a:1": "auto_high_confidence", "b:1": "auto_high_confidence", "a:2": "needs_review", "b:2": "needs_review"}
    ruled = review.recommend(review.review_queue(cand, got)).collect()
    assert [(r["left_key"], r["review_hint"], r["review_decision"], r["auto_apply"]) for r in ruled] == [("a:2", "qualifier_conflict_check_separate_projects", "different_project", True)]
    cid = ruled[0]["candidate_id"]
    made = spark.createDataFrame([(cid, "same_project"), ("MC-none", "same_project"), (cid, "perhaps")], "candidate_id string, review_decision string")
    after, applied = review.apply_decisions(got, cand, made)
    ids = {r["record_key"]: (r["project_match_id"], r["match_status"]) for r in after.collect()}
    assert ids["a:2"] == ids["b:2"] and ids["a:2"][1] == "human_confirmed" and ids["a:1"][1] == "auto_high_confidence"
    assert sorted(r["application_status"] for r in applied.collect()) == ["applied", "candidate_not_found", "invalid_decision"]
    closed = review.reconcile(got, cand.limit(0)).collect()
    assert sum(r["match_status"] == "reviewed_no_match" for r in closed) == 2


def test_audit(spark):
    rows = [("1", "a", "b", "same_project"), ("2", "b", "c", "same_project"), ("3", "a", "c", "different_project"), ("4", "x", "y", "uncertain"), ("5", "b", "a", "different_project")]
    d = spark.createDataFrame(rows, "candidate_id string, left_key string, right_key string, review_decision string")
    cand = d.drop("review_decision").withColumn("status", F.lit("reviewed")).filter("candidate_id <> '4'")
    ents = spark.createDataFrame([("E1", "a"), ("E1", "b"), ("E2", "c"), ("E3", "x")], "project_entity_id string, record_key string")
    applied = d.select("candidate_id", "review_decision", F.lit("applied").alias("application_status")).filter("candidate_id <> '2'")
    got = {(r["check"], r["key"]) for r in review.audit(d, cand, ents, applied).collect()}
    assert got == {
        ("transitive_contradiction", "3"), ("transitive_contradiction", "5"), ("opposing_decisions_for_pair", "1"), ("invalid_decision", "4"), ("unknown_candidate", "4"), ("missing_applied_row", "2"),
        ("record_missing_from_index", "y"), ("same_project_split", "2"), ("different_project_collapsed", "5"),
    }


def test_components(spark):
    edges = [(f"n{k:03}", f"n{k + 1:03}") for k in range(40)] + [("z", "z"), ("s0", "s1"), ("s0", "s2"), ("s1", "s2"), ("s1", "s0"), (None, "q")]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect())
    assert got == {f"n{k:03}": "n000" for k in range(41)} | {"z": "z", "s0": "s0", "s1": "s0", "s2": "s0"}
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_components_of_titles_are_taken_once(spark):
    df = spark.createDataFrame([("Phase II, lot 3", "lot 4, phase 2"), ("phase 1", "second phase"), ("lot 1", "phase 2"), ("", "lot 2")], "a string, b string")
    clash = df.select(E.component_clash(E.components(F.col("a")), E.components(F.col("b"))).alias("x"), E.events_clash(F.col("a"), F.col("b")).alias("y"))
    assert [tuple(r) for r in clash.collect()] == [(True, True), (True, True), (False, False), (False, False)]
    alone = df.select(E.component_clash(E.components(F.col("a")), E.components(F.col("b"))).alias("x"))
    assert alone._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 8


def test_rounds_read_little_more_than_the_first(spark, monkeypatch):
    """A chain in order of its nodes, and hubs: the edges of all rounds after the first together are fewer than those of the input."""
    from panelweave.operators import graph

    seen, write = [], graph.durable_with

    def noted(*args):
        out = write(*args)
        seen.append(out[1]["edges"])
        return out

    monkeypatch.setattr(graph, "durable_with", noted)
    edges = [(f"k{k:05}", f"k{k + 1:05}") for k in range(1500)] + [(f"p{k:03}", f"s{k % 7}") for k in range(500)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {f"k{k:05}": "k00000" for k in range(1501)} | {n: f"p{int(n[1:]) % 7:03}" for e in edges[1500:] for n in e}
    assert sum(seen) < 1.5 * len(edges)


def test_ids_that_meet_are_hashed_anew(spark, monkeypatch):
    """Nodes whose hashes are equal stay apart."""
    from panelweave.operators import graph

    hashed = graph._hash
    monkeypatch.setattr(graph, "_hash", lambda node, seed: hashed(node, seed) % 3 if seed < 2 else hashed(node, seed))
    edges = [(f"a{k}", f"b{k}") for k in range(20)] + [("a1", "a1"), ("c", "c"), (None, "d"), ("a2", "b2")]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {f"{x}{k}": f"a{k}" for k in range(20) for x in "ab"} | {"c": "c"}
