"""Panels, statistics, breaks and sources on small rows."""

import csv
import itertools
import json
import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from panelweave.functions import clean
from panelweave.operators import breaks, dashboards, panel, stats
from panelweave.sources import adapters, files

REC = "entity string, period int, source string, fund string, amount double"


def test_missing_is_not_zero(spark):
    recs = spark.createDataFrame([("A", 1, "s", "loan", None), ("A", 2, "s", "loan", 0.0), ("Z", 1, "s", "loan", 5.0)], REC)
    ents = spark.createDataFrame([("A",), ("B",)], "entity string")
    got = {(r["entity"], r["period"]): (r["record_count"], r["known_count"], r["total"]) for r in panel.long_panel(recs, ents, ["s"], 1, 2).collect()}
    assert got == {("A", 1): (1, 0, None), ("A", 2): (1, 1, 0.0), ("B", 1): (0, 0, None), ("B", 2): (0, 0, None)}
    wide = panel.wide_panel(recs, ents, ["s", "t"], 1, 2).collect()
    assert len(wide) == 4 and all(r["t_count"] == 0 and r["t_total"] is None for r in wide)
    parts = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "year int, v double")
    assert {r["year"]: r["v"] for r in panel.periods_from_parts(parts, ["year"], ["v"]).collect()} == {1: None, 2: 3.0}
    assert {r["year"]: r["v"] for r in panel.periods_from_parts(parts, ["year"], ["v"], legacy_zero=True).collect()} == {1: 0.0, 2: 3.0}


def test_zero_spread_has_no_outlier(spark):
    same = spark.createDataFrame([("g", 100.0)] * 10 + [("g", 1e9)], "g string, amount double")
    assert stats.outliers(same, ["g"]).count() == 0
    mixed = spark.createDataFrame([("g", float(10 + k)) for k in range(12)] + [("g", 1e9), ("g", -1.0), ("g", None)], "g string, amount double")
    assert sorted(r["method"] for r in stats.outliers(mixed, ["g"]).collect()) == ["nonpositive_amount", "source_measure_log_mad"]


@pytest.mark.parametrize("x,y", [([1, 2, 3], [10, 20, 30]), ([1, 2, 3], [30, 20, 10]), ([1, 1, 2], [1, 2, 3]), ([1, 1, 1], [1, 2, 3]), ([3, 1, 2, 2, 5, 5], [1, 1, 4, 4, 2, 3])])
def test_rank_statistics(spark, x, y):
    def ranks(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]

    def rho(a, b):
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        sa, sb = sum((p - ma) ** 2 for p in a), sum((q - mb) ** 2 for q in b)
        return sum((p - ma) * (q - mb) for p, q in zip(a, b)) / math.sqrt(sa * sb) if sa and sb else None

    c = d = tx = ty = 0
    for i in range(len(x)):
        for j in range(i):
            dx, dy = x[i] - x[j], y[i] - y[j]
            c, d, tx, ty = c + (dx * dy > 0), d + (dx * dy < 0), tx + (dx == 0 != dy), ty + (dy == 0 != dx)
    tau = (c - d) / math.sqrt((c + d + tx) * (c + d + ty)) if (c + d + tx) * (c + d + ty) else None
    points = spark.createDataFrame([("k", str(i), float(a), float(b), 1) for i, (a, b) in enumerate(zip(x, y))], "k string, point string, x double, y double, shared int")
    assert stats.spearman(points, ["k"]).first()["spearman_rho"] == pytest.approx(rho(ranks(x), ranks(y)), abs=1e-6)
    got = stats.kendall(points, ["k"]).collect()
    assert (got[0]["kendall_tau_b"] if got else None) == pytest.approx(tau, abs=1e-6)


def best_breaks(values, least=4, most=3):
    nonzero = sorted(abs(v) for v in values if v)
    scale = (nonzero[(len(nonzero) - 1) // 2] + nonzero[len(nonzero) // 2]) / 2 if nonzero else 1.0
    t, n = [math.asinh(v / scale) for v in values], len(values)
    out = []

    def walk(cuts, left):
        edges = [0, *cuts, n]
        if all(b - a >= least for a, b in zip(edges, edges[1:])):
            sse = sum(sum((v - sum(t[a:b]) / (b - a)) ** 2 for v in t[a:b]) for a, b in zip(edges, edges[1:]))
            out.append((n * math.log(max(sse, 1e-12) / n) + (2 * len(edges) - 3) * math.log(n), cuts))
        if left:
            for k in range((cuts[-1] if cuts else 0) + least, n - least + 1):
                walk([*cuts, k], left - 1)

    walk([], most)
    return min(out)


def test_breaks(spark):
    rng = random.Random(4)
    series = {"step": [1.0] * 8 + [10.0] * 8, "noise": [rng.random() + 3 * (k > 9) for k in range(20)], "two": [rng.gauss(0, 0.1) + (k > 5) * 4 - (k > 14) * 6 for k in range(22)], "short": [1.0] * 7}
    rows = [(s, 2000 + k, v) for s, vs in series.items() for k, v in enumerate(vs)] + [("step", 1990, 5.0), ("step", 1995, None)]
    df = spark.createDataFrame(rows, "series string, period int, value double")
    got = {r["series"]: r for r in breaks.mean_breaks(df).collect()}
    assert set(got) == {"step", "noise", "two"}
    assert got["step"]["break_indices"] == [8] and got["step"]["bic_improvement"] > 10
    for s in ("noise", "two"):
        bic, cuts = best_breaks(series[s])
        assert got[s]["break_indices"] == cuts and got[s]["bic"] == pytest.approx(bic, abs=1e-6)
    point = breaks.breakpoints(df, breaks.mean_breaks(df)).filter("series = 'step'").first()
    assert (point["break_period"], point["pre_mean"], point["post_mean"], point["relative_change"], point["evidence_strength"]) == (2008, 1.0, 10.0, 9.0, "strong")
    zeros = spark.createDataFrame([("z", k, 0.0) for k in range(9)], "series string, period int, value double")
    assert breaks.mean_breaks(zeros).first()["break_indices"] == []


def test_longest_run_takes_the_earliest(spark):
    df = spark.createDataFrame([("s", p, 1.0) for p in (1, 2, 3, 7, 8, 9, 12)], "series string, period int, value double")
    assert sorted(r["period"] for r in breaks.longest_run(df).collect()) == [1, 2, 3]


def test_adapters(spark, tmp_path):
    def put(name, header, *rows):
        (tmp_path / name).write_text("﻿" + "\n".join([",".join(header), *(",".join(r) for r in rows)]) + "\n", encoding="utf-8")

    put("fdi_africa_metadata.csv", ["ISO_A3", "Country_EN", "Country_CN", "Is_Sovereign"], ["KEN", "Kenya", "肯尼亚", "1"], ["SDN-H", "Sudan", "苏丹", "1"])
    for s in adapters.SOURCES:
        names = [s.record_id, s.entity, *([s.period] if isinstance(s.period, str) else s.period), *([s.title] if isinstance(s.title, str) else s.title), *([s.value] if s.value else []), *([s.regional] if s.regional else []), "BU_ID"]
        header = list(dict.fromkeys(names))
        cells = {s.record_id: "7", s.entity: "KEN" if s.by_iso else "肯尼亚", s.value: "1.5"} | {p: "FY2012" for p in ([s.period] if isinstance(s.period, str) else s.period)}
        put(s.file, header, [cells.get(h, "7" if h == "BU_ID" else "") for h in header])
    put(adapters.COFI.file, ["country_iso3c", "unique_id", "debt_investment_amount_USD", "debt_investment_year", "equity_investor_amount_1_USD", "equity_investor_amount_2_USD", "equity_investment_year", "commissioning_year", "total_investment_amount_USD"], ["ken", "1", "5", "2010", "2", "", "2011", "", ""], ["ken", "2", "", "", "", "", "", "2015", "9"])
    got = {r["record_key"]: r for r in adapters.all_records(spark, str(tmp_path)).collect()}
    assert len(got) == 11 and {r["entity"] for r in got.values()} == {"KEN"}
    assert got["cla:7"]["amount"] == 1_500_000.0 and got["aiddata:7"]["period"] == 2012
    assert (got["cofi:1:debt"]["amount"], got["cofi:1:equity"]["amount"], got["cofi:2:total"]["amount"], got["cofi:2:total"]["period"]) == (5.0, 2.0, 9.0, 2015)
    assert got["cgp:7"]["refs"] == ["cla:7", "cgef:7"] and got["chapo:7"]["refs"] == ["aiddata:7"] and got["cgp:7"]["amount"] is None
    ranged = {r["record_key"]: r for r in adapters.all_records(spark, str(tmp_path), ranges=True).drop("ordinal").collect()}
    assert ranged == {k: Row(**{c: v for c, v in r.asDict().items() if c != "ordinal"}) for k, r in got.items()}
    assert files.field_count(spark, [str(tmp_path / "fdi_africa_metadata.csv")]) == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], None)], "k string, l array<string>, n int")
    assert files.write_csv(df, str(tmp_path / "t.csv"), ["k", "l", "n", "absent"]) == 1
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [("a", "x|y", None, None)]
    assert files.read_optional_csv(spark, str(tmp_path / "no.csv"), ["a"]).collect() == []
    d = spark.createDataFrame([("1", "same_project"), ("1", "uncertain"), ("2", "bad")], "candidate_id string, review_decision string").coalesce(1)
    files.export_decisions(d, str(tmp_path / "d.csv"))
    assert [(r["candidate_id"], r["review_decision"]) for r in files.import_decisions(spark, str(tmp_path / "d.csv")).collect()] == [("1", "uncertain")]
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"CONTINENT": "Africa", "ISO_A3": "-99", "ADM0_A3": "SOL", "NAME": "S"}, "geometry": {"type": "Point"}}, {"properties": {"CONTINENT": "Asia", "ISO_A3": "X"}, "geometry": null}]}')
    assert [r["iso3"] for r in files.read_features(spark, str(tmp_path / "g.json")).collect()] == ["SOL"]


def test_document_of_many_rows(spark, tmp_path):
    """Rows in order whatever their tasks, repeated and null ones too, and one file."""
    rng = random.Random(3)
    rows = [(rng.choice(["é", 'q"', "a\nb", "z", None]), rng.randrange(300), [rng.randrange(3)]) for _ in range(3000)]
    many = spark.createDataFrame(rows, "k string, n int, l array<int>").repartition(7)
    files.write_document({"none": many.filter("n < 0"), "many": many, "total": many.agg(F.sum("n").alias("n")), "absent": many.filter("n < 0")}, str(tmp_path / "doc"), one_row=("total", "absent"))
    (file,) = (tmp_path / "doc").glob("part-*")
    got = json.loads(file.read_text(encoding="utf-8"))
    want = [{"k": k, "n": n, "l": v} for k, n, v in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1:]))]
    assert got == {"none": [], "many": want, "total": {"n": sum(n for _, n, _ in rows)}, "absent": None} and list(got) == ["none", "many", "total", "absent"]


def plain_splits(t, least=4, most=3):
    """The recurrence over all last breaks: squared errors by prefix sums, equals to the earliest."""
    s, q = [0.0], [0.0]
    for v in t:
        s.append(s[-1] + v)
        q.append(q[-1] + v * v)
    sse = lambda i, j: max(0.0, q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i))
    best = {j: (0, [], sse(0, j)) for j in range(least, len(t) + 1)}
    for k in range(1, most + 2):
        if len(t) in best:
            yield k, best[len(t)][1][::-1], pytest.approx(best[len(t)][2], abs=1e-9)
        best = {j: min((round(best[i][2] + sse(i, j), 12), [i, *best[i][1]], best[i][2] + sse(i, j)) for i in range(k * least, j - least + 1)) for j in range((k + 1) * least, len(t) + 1)}


def test_no_break_is_lost():
    rng = random.Random(12)
    for trial in range(60):
        n = rng.randrange(4, 120)
        t = [rng.gauss(0, 1) for _ in range(n)]
        if trial % 3 == 1:
            t = [float(round(v) + 3 * (k > n // 2)) for k, v in enumerate(t)]
        elif trial % 3 == 2:
            t = [t[k - k % 20] for k in range(n)]
        want = list(plain_splits(t))
        for stride in (1, 7, 64):
            got = list(breaks.best_splits(np.array(t), 4, 3, stride))
            assert got == want[: len(got)] and (len(got) == len(want) or got[-1][2] <= 1e-12), (trial, stride)


def test_breaks_of_a_very_long_series(spark):
    """50,000 values, of which few last breaks stay in question."""
    rng = random.Random(2)
    rows = [("s", k, (20.0 if k < 12000 else 90.0 if k < 31000 else 40.0) + rng.gauss(0, 3)) for k in range(50000)]
    got = breaks.mean_breaks(spark.createDataFrame(rows, "series string, period int, value double")).first()
    assert {12000, 31000} <= set(got["break_indices"])


def test_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(8)
    values = [2.675, 0.125, 0.375, 2.5, 0.5, 1.5, 1.005, -2.675, 0.0, 1e15 + 0.3, 4503599627370497.5, 1e300, 123456.7890125, 8.5, -0.5]
    values += [rng.randrange(10**7) / 10**5 for _ in range(500)] + [rng.random() * 10 ** rng.randrange(-6, 14) for _ in range(500)] + [rng.randrange(10**6) / 64 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for places in (0, 2, 4, 6):
        got = [r[0] for r in df.select(clean.round_half_even(F.col("v"), places)).collect()]
        assert got == [round(v, places) for v in values] + [None]


def test_names_with_accents_stand_beside_their_letters(spark):
    names = ["Zambia", "Égypte", "Eritrea", "Côte d'Ivoire", "Cuba", "Comoros", "egret", "Ethiopia"]
    df = spark.createDataFrame([(n, 1, 1) for n in names], "entity string, records int, source_count int")
    assert [r["entity"] for r in dashboards.rank_entities(df, "name").collect()] == ["Comoros", "Côte d'Ivoire", "Cuba", "egret", "Égypte", "Eritrea", "Ethiopia", "Zambia"]


def test_quoted_lines_over_many_ranges(spark, tmp_path):
    """A file of records over several lines is read by several tasks: same rows as one reader, numbered in order."""
    rng = random.Random(12)
    cell = lambda: "".join(rng.choice(["a", "b,", '"', "\n", " ", "é", "\n\n", '""', "x" * 30, ""]) for _ in range(rng.randrange(12)))
    data = [(str(k), cell(), cell()) for k in range(3000)]
    with open(tmp_path / "t.csv", "w", encoding="utf-8", newline="") as f:
        f.write("\ufeff")
        out = csv.writer(f, lineterminator="\n")
        out.writerows([("id", "one", "two\nlines"), *data[:2000]])
        f.write("\n")
        out.writerows(data[2000:])
    path = str(tmp_path / "t.csv")
    want = [(a, b or None, c or None) for a, b, c in data]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(path, lineSep="\n").rdd.getNumPartitions() > 10
        df = files.read_csv_ranges(spark, path)
        assert df.columns == ["id", "one", "two\nlines", "ordinal"]
        got = [tuple(r) for r in df.orderBy("ordinal").collect()]
        assert [r[:3] for r in got] == want and len({r[3] for r in got}) == len(want)
        assert [tuple(r) for r in files.read_csv_ranges(spark, path, ["absent", "id"]).orderBy("ordinal").select("absent", "id").limit(2).collect()] == [(None, "0"), (None, "1")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture
def many_ranges(spark):
    """Small shuffles keep their partitions, so that a group of a test spans several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_group_that_spans_all_ranges(spark, many_ranges):
    """200,000 points of one group: ranks, tau and medians against plain counts."""
    n = 200_000
    x, y = [k * 7919 % 50021 for k in range(n)], [(k * k + k * 3) % 9973 for k in range(n)]
    points = spark.range(n, numPartitions=8).selectExpr("'g' k", "string(id) point", "double(id * 7919 % 50021) x", "double((id * id + id * 3) % 9973) y", "1 shared")
    points = points.unionByName(points.limit(1).selectExpr("'h' k", "point", "x", "y", "shared"))
    ranges = points.groupBy("k", "x").agg(F.count("*").alias("n")).repartitionByRange("k", "x").select("k", F.spark_partition_id().alias("p")).distinct().filter("k = 'g'").count()
    assert ranges > 1  # the group is more than one task
    tree, seen, swaps = [0] * 9974, 0, 0
    for _, same in itertools.groupby(sorted(zip(x, y)), key=lambda p: p[0]):
        same = [b for _, b in same]
        for b in same:  # larger y at smaller x
            k, upto = b + 1, 0
            while k:
                upto, k = upto + tree[k], k & (k - 1)
            swaps += seen - upto
        for b in same:
            k, seen = b + 1, seen + 1
            while k < len(tree):
                tree[k], k = tree[k] + 1, k + (k & -k)
    pairs = lambda rows: sum(c * (c - 1) // 2 for c in Counter(rows).values())
    every, tx, ty, both = n * (n - 1) // 2, pairs(x), pairs(y), pairs(zip(x, y))
    want = (every - tx - ty + both - 2 * swaps) / math.sqrt((every - tx) * (every - ty))
    got = {r["k"]: r for r in stats.kendall(points, ["k"]).collect()}
    assert got["g"]["kendall_tau_b"] == pytest.approx(want, abs=1e-6)
    rho = {r["k"]: (r["paired_observations"], r["spearman_rho"]) for r in stats.spearman(points, ["k"]).collect()}
    places = {v: i for i, v in reversed(list(enumerate(sorted(x))))}, {v: i for i, v in reversed(list(enumerate(sorted(y))))}
    (px, cx), (py, cy) = zip(places, (Counter(x), Counter(y)))
    rank = [(px[a] + (cx[a] - 1) / 2 - (n - 1) / 2, py[b] + (cy[b] - 1) / 2 - (n - 1) / 2) for a, b in zip(x, y)]
    assert rho["g"] == (n, pytest.approx(sum(a * b for a, b in rank) / math.sqrt(sum(a * a for a, _ in rank) * sum(b * b for _, b in rank)), abs=1e-6)) and rho["h"] == (1, None)
    assert {r["k"]: r["upper_median"] for r in stats.upper_medians(points, ["k"], "x").collect()}["g"] == sorted(x)[n // 2]


def test_outliers_of_one_hot_group(spark, many_ranges):
    """Medians and deviations of a group with most rows, and of a small and an even one, against plain ones."""
    rows = spark.range(60_001, numPartitions=6).selectExpr("CASE WHEN id % 1000 < 996 THEN 'hot' WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END g", "id", "CASE WHEN id % 5003 = 0 THEN 1e12 WHEN id % 7001 = 0 THEN -1.0D ELSE double(1000 + id * 31 % 997) END amount")
    plain: dict[str, list] = {}
    data = rows.collect()
    for r in data:
        plain.setdefault(r["g"], []).append(r["amount"])
    want = {}
    for r in data:
        if r["g"] not in want:
            values = [v for v in plain[r["g"]] if v > 0]
            logs = [math.log10(v) for v in values]
            want[r["g"]] = (statistics.median(logs), None, statistics.median(values), len(values))
    for g, (centre, _, middle, size) in want.items():
        want[g] = (centre, statistics.median(abs(math.log10(v) - centre) for v in plain[g] if v > 0), middle, size)
    expected = {}
    for r in data:
        centre, mad, middle, size = want[r["g"]]
        if r["amount"] <= 0:
            expected[r["id"]] = ("nonpositive_amount", middle, size)
        elif abs(round(0.6745 * (math.log10(r["amount"]) - centre) / mad, 4)) > 3.5:
            expected[r["id"]] = ("source_measure_log_mad", middle, size)
    got = {r["id"]: (r["method"], r["group_median"], r["group_count"]) for r in stats.outliers(rows, ["g"]).collect()}
    assert got == expected and len(got) > 15
