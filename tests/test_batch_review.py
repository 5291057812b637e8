"""Title evidence and the batch review of a queue."""

import random

import pytest
from pyspark.sql import functions as F

from panelweave.functions import evidence as E
from panelweave.operators import batch_review as B
from panelweave.operators import matching, publish, review

QUEUE = "candidate_id string, ordinal long, left_key string, right_key string, left_source string, right_source string, left_record_id string, right_record_id string, left_title string, right_title string, left_fund string, right_fund string, left_sector string, right_sector string, left_amount double, right_amount double"


def queue(spark, pairs):
    rows = []
    for k, (left, right, lt, rt, *more) in enumerate(pairs):
        a = dict(left_fund="loan", right_fund="loan", left_sector="other", right_sector="energy", left_amount=None, right_amount=None) | (more[0] if more else {})
        (ls, li), (rs, ri) = left.split(":", 1), right.split(":", 1)
        rows.append((f"c{k}", k, left, right, ls, rs, li, ri, lt, rt, a["left_fund"], a["right_fund"], a["left_sector"], a["right_sector"], a["left_amount"], a["right_amount"]))
    return spark.createDataFrame(rows, QUEUE)


def records(spark, keys, groups=None, titles=None):
    rows = [(k, *k.split(":", 1), (titles or {}).get(k, ""), (groups or {}).get(k, f"SRC-{k}"), "direct_reference" if k in (groups or {}) else "unmatched") for k in keys]
    return spark.createDataFrame(rows, "record_key string, source string, record_id string, title string, project_match_id string, match_status string")


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_evidence(spark):
    t = [("Second Phase, lot 3 and Phase VIII",), ("1st tranche",), (None,), ("phases",)]
    assert one(spark, t, "t string", E.components(F.col("t"))) == [["lot:3", "phase:2", "phase:8"], ["tranche:1"], [], []]
    m = [tuple(x) for x in one(spark, [("USD 1,5 million, EUR 2.5bn and $7 or rmb 1.2.3",)], "t string", E.money_in(F.col("t")))[0]]
    assert m == [("usd", 15e6), ("eur", 2.5e9), ("usd", 7.0)]
    assert one(spark, [("usd 100 million", 102e6), ("usd 100 million", 110e6), ("none", 5.0), ("usd 1", None)], "t string, n double", E.states_usd(F.col("t"), F.col("n"))) == [True, False, False, False]
    assert one(spark, [("a 1,200 MW and 33kV",)], "t string", E.specs(F.col("t"))) == [["mw:1200.0", "kv:33.0"]]
    ids = [("linked to record #12, 345", "345"), ("Record ID#" + " x" * 70 + " 345", "345"), ("ID 12 345", "345"), ("id 1345", "345"), ("id ab", "ab"), ("x 345", "345")]
    assert one(spark, ids, "t string, i string", E.names_record(F.col("t"), F.col("i"))) == [True, False, True, False, False, False]
    events = [("May team", "June team"), ("two million doses", "x"), ("1 million covid vaccine doses", "500 thousand doses"), ("usd 5", "usd 6 and usd 5"), ("Phase 1", "phase II"), ("a", "b")]
    assert one(spark, events, "a string, b string", E.events_clash(F.col("a"), F.col("b"))) == [True, False, True, False, True, False]


def test_rules(spark):
    q = queue(spark, [
        ("aiddata:1", "cla:9", "Kafue Gorge loan USD 50 million", "Kafue Gorge", {"right_amount": 50e6}),
        ("aiddata:2", "cofi:8:debt", "Bui 400 MW station", "Bui 400MW", {}),
        ("cla:1", "codf:2", "Road", "Road", {}),
        ("aiddata:3", "chapo:4", "May medical team", "June medical team", {}),
        ("aiddata:5", "cgp:6", "Soubre hydropower", "Soubre Dam", {}),
        ("aiddata:7", "cgp:7", "Malabo hydropower", "Malabo water treatment plant", {"right_sector": "water"}),
        ("cgp:10.2", "cofi:10:debt", "De Aar Wind", "DE AAR-II", {}),
        ("cgp:10.1", "cofi:11:debt", "De Aar Wind", "DE AAR-II", {}),
        ("aiddata:12", "cla:12", "Plain", "Other", {"left_fund": "grant"}),
        ("aiddata:13", "cla:13", "Plain one", "Other two", {}),
        ("aiddata:14", "chapo:15", "linked to record 15", "anything", {"left_amount": 9.0, "right_amount": 10.0}),
    ])
    keys = {r[k] for r in q.collect() for k in ("left_key", "right_key")}
    none = spark.createDataFrame([], "candidate_id string, left_key string, right_key string, review_decision string")
    got = {r["candidate_id"]: r["rule_id"] for r in B.batch_review(q, records(spark, keys), none).collect()}
    assert got == {
        "c0": "matching_original_usd_commitment", "c1": "matching_named_project_specs", "c2": "distinct_related_catalog_identifiers", "c3": "conflicting_canonical_event_details", "c4": "distinctive_named_asset_with_compatible_context",
        "c6": "matching_catalog_component_ordinal", "c7": "conflicting_catalog_component_ordinal", "c8": "conflicting_financing_instruments", "c10": "explicit_cross_source_record_link",
    }
    done = {r["candidate_id"]: (r["rule_id"], r["review_decision"]) for r in B.batch_review(q, records(spark, keys), none, complete=True).collect()}
    assert done["c5"] == done["c9"] == ("separate_after_full_evidence_check", "different_project")


def test_closures(spark):
    """Equivalent ids carry decisions over, and a difference walls off what would join its ends."""
    keys = ["aiddata:1", "chapo:1", "cofi:a", "cgp:b", "restruct:c"]
    q = queue(spark, [("chapo:1", "cgp:b", "x", "y"), ("chapo:1", "cofi:a", "x", "y"), ("cgp:b", "restruct:c", "Bagre dam", "Bagre hydro"), ("cofi:a", "restruct:c", "Bagre dam", "Bagre hydro"), ("cofi:a", "cgp:b", "Bagre dam", "Bagre hydro")])
    made = spark.createDataFrame([("p", "aiddata:1", "cofi:a", "same_project"), ("q", "aiddata:1", "cgp:b", "different_project")], "candidate_id string, left_key string, right_key string, review_decision string")
    got = {r["candidate_id"]: r["rule_id"] for r in B.batch_review(q, records(spark, keys), made).collect()}
    assert got == {
        "c0": "reviewed_difference_equivalence_closure", "c1": "reviewed_same_equivalence_closure", "c2": "distinctive_named_asset_with_compatible_context",
        "c3": "reviewed_difference_final_entity_guard", "c4": "reviewed_difference_final_entity_guard",
    }


def decide_one_by_one(rows):
    """(candidate_id, rule_id): open pairs in queue order, pass after pass, with components and differences as plain sets."""
    parts = {"reviewed": [], "entity": []}
    label = {"reviewed": {}, "entity": {}}
    for r in rows:
        for kind in label:
            for side in ("left", "right"):
                label[kind].setdefault(r[f"{kind}_{side}"], r[f"{kind}_{side}"])
        if r["different"]:
            for kind in parts:
                parts[kind].append((r[f"{kind}_left"], r[f"{kind}_right"]))

    def apart(kind, a, b):
        of = label[kind]
        return any({of[u], of[v]} == {a, b} for u, v in parts[kind])

    open_, out, moved = sorted((r for r in rows if not r["different"]), key=lambda r: (r["ordinal"], r["candidate_id"])), [], True
    while moved:
        moved, left = False, []
        for r in open_:
            (a, b), (c, d) = ((label[k][r[f"{k}_left"]], label[k][r[f"{k}_right"]]) for k in ("reviewed", "entity"))
            if apart("entity", c, d):
                rule = "reviewed_difference_final_entity_guard"
            elif r["part_rule"]:
                rule = r["part_rule"]
            elif a == b:
                rule = "reviewed_same_equivalence_closure"
            elif apart("reviewed", a, b):
                rule = "reviewed_difference_equivalence_closure"
            else:
                rule = r["own_rule"]
            if not rule:
                left.append(r)
                continue
            moved = True
            out.append((r["candidate_id"], rule))
            if not rule.startswith(("conflicting", "distinct_related", "reviewed_difference")):
                for kind, x, y in (("reviewed", a, b), ("entity", c, d)):
                    label[kind] = {n: y if v == x else v for n, v in label[kind].items()}
        open_ = left
    return sorted(out)


CLOSURE = "candidate_id string, ordinal long, different boolean, part_rule string, own_rule string, reviewed_left string, reviewed_right string, entity_left string, entity_right string"


def closed(spark, rows):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], CLOSURE)
    return sorted(tuple(r) for r in B.ordered_closure(df.filter("not different"), df.filter("different")).select("candidate_id", "rule_id").collect())


@pytest.mark.parametrize("seed", range(4))
def test_rounds_decide_like_one_after_the_other(spark, seed):
    """Random queues: many small components at once, and one in which all pairs hang together."""
    rng, rows = random.Random(seed), []
    for block in range(40 if seed % 2 else 2):
        nodes = rng.choice([4, 6, 8]) if seed % 2 else 25
        review = {k: rng.randrange(nodes) for k in range(nodes)}
        entity = {k: rng.randrange(nodes) for k in range(nodes)}
        for k in range(rng.randrange(4, 14) if seed % 2 else 45):
            a, b = rng.sample(range(nodes), 2)
            different = rng.random() < 0.15
            rows.append({
                "candidate_id": f"{block}/{k}", "ordinal": -1 if different else rng.randrange(60), "different": different, "part_rule": rng.choice([None] * 6 + ["matching_catalog_component_ordinal"]),
                "own_rule": rng.choice([None, None, "named", "conflicting_x"]), "reviewed_left": f"{block}r{review[a]}", "reviewed_right": f"{block}r{review[b]}", "entity_left": f"{block}e{entity[a]}", "entity_right": f"{block}e{entity[b]}",
            })
    want = decide_one_by_one(rows)
    assert closed(spark, rows) == want and len({r for _, r in want}) > 3


def test_hub(spark):
    """A component that a hundred pairs touch, of which most join nothing."""
    base = {"different": False, "part_rule": None}
    ends = lambda a, b: {"reviewed_left": a, "reviewed_right": b, "entity_left": a, "entity_right": b}
    rows = [{"candidate_id": f"{k:03}", "ordinal": k, **base, "own_rule": "named" if k in (40, 60) else None if k % 2 else "conflicting_x", **ends("hub", f"n{k % 50}")} for k in range(100)]
    rows += [{"candidate_id": "d", "ordinal": -1, **base, "own_rule": None, **ends("n40", "n10"), "different": True}]
    assert closed(spark, rows) == decide_one_by_one(rows)


def by_records(records):
    """The review of a queue of pairs of records."""
    recs, cand = matching.apply_matching(records)
    queue = publish.numbered(review.review_queue(cand, recs), *publish.order_of("candidates")).withColumnRenamed("position", "ordinal")
    known = review.recommend(queue).filter("auto_apply and ordinal % 3 = 0").select("candidate_id", "left_key", "right_key", "review_decision")
    return B.batch_review(queue, recs, known, complete=True)


def catalogue_copies(spark, copies):
    """Records of one block, repeated in load order: ids that titles name, that two sources share, that number parts, and references."""
    rng, rows = random.Random(3), []
    words = ["de aar wind farm", "de aar wind farm ii", "de aar wind dam 400 MW", "de aar wind, id 7712 and usd 5 million", "de aar wind farm of may", "de aar wind farm of june"]
    base = [(rng.choice(["aiddata", "chapo", "cla", "cofi", "cgp"]), rng.choice(words), rng.choice([None, 5e6]), rng.choice(["loan", "grant"])) for _ in range(36)]
    for c in range(copies):
        for k, (source, title, amount, fund) in enumerate(base):
            n = 1000 * (c + 1) + k
            ident = {"cgp": f"{n}.{k % 3}", "cofi": f"{n}:debt" if k % 2 else f"{n}"}.get(source, f"{n}")
            ident = "7712" if source == "chapo" and k % 3 == 0 and c == 0 else "881" if k in (4, 9, 14) and source in ("aiddata", "chapo") else ident
            refs = [f"{base[k + 1][0]}:{n + 1}"] if k % 12 == 0 and c == 0 else []  # each grouped record is a class of its own
            rows.append((f"{source}:{ident}/{k}" if ident in ("7712", "881") and k % 2 else f"{source}:{ident}", source, ident, title, "E", 1, n, amount, "usd", "c", fund, "energy", refs))
    rows = list({r[0]: r for r in rows}.values())
    return spark.createDataFrame(rows, "record_key string, source string, record_id string, title string, entity string, period int, ordinal long, amount double, price_basis string, amount_measure string, fund string, sector string, refs array<string>")


def test_rules_of_copies(spark):
    """What rules find for a pair of classes they find for each pair of records that it stands for; pairs do not grow with copies."""
    sizes = []
    for copies in (2, 4):
        recs = catalogue_copies(spark, copies)
        matched, links, members, _ = matching.match_by_classes(recs)
        copied = review.copies(members, matched, B.told_apart(matched))
        rule = ("hard_rule", "part_rule", "own_rule")
        of = lambda q, r: {(x["left_key"], x["right_key"]): tuple(x[c] for c in rule) for x in B.judged_alone(q, r).collect()}
        got = of(review.class_queue(links, copied, matched), B.without_copies(matched, copied))
        want = of(review.review_queue(*matching.apply_matching(recs)[::-1]), matched)
        name = {r["record_key"]: r["copy_key"] for r in copied.collect()}
        assert {(name[a], name[b]): x for (a, b), x in want.items()} == got
        assert all(got[name[a], name[b]] == x for (a, b), x in want.items()) and len({x for t in want.values() for x in t if x}) > 4
        sizes.append((len(want), len(got)))
    assert sizes[1][0] > 3 * sizes[0][0] and sizes[1][1] < 1.5 * sizes[0][1]


def test_query_like_one_after_the_other(spark, sf_dir, monkeypatch):
    """The registered query, row by row, against the loop over its own queue."""
    from panelweave.plans import queries

    asked = {}

    def loop(pairs, different):
        rows = [r.asDict() for r in pairs.unionByName(different).collect()]
        asked["n"] = len(rows)
        return spark.createDataFrame(decide_one_by_one(rows), "candidate_id string, rule_id string")

    key = lambda df: sorted(map(tuple, df.select("candidate_id", "review_decision", "rule_id").collect()))
    rows = queries.batch_reviewed(spark, sf_dir).cache()
    got = key(rows.filter("kind = 'pair'"))
    assert rows.filter("kind = 'member' and left_key <> right_key").count() == 0  # no copies: as the queue of all pairs of records
    assert got == key(by_records(queries._catalogues(spark, sf_dir)))
    monkeypatch.setattr(B, "ordered_closure", loop)
    assert key(queries.batch_reviewed(spark, sf_dir).filter("kind = 'pair'")) == got and asked["n"] > 20


def test_origins(spark):
    notes = [("BATCH_REVIEW rule_x: because",), ("HUMAN_REVIEW yes",), ("seen",), (None,)]
    assert one(spark, notes, "n string", F.struct(*B.origin_of(F.col("n")))) == [("batch", "rule_x"), ("human", "imported_human_decision"), ("existing", "preserved_existing_decision"), ("existing", "preserved_existing_decision")]
