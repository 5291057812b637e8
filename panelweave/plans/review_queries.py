"""Queries of reviews, published order, checks and dashboards, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions import clean as C
from panelweave.functions import evidence as E
from panelweave.operators import batch_review, breaks, dashboards, matching, panel, publish, review, stats
from panelweave.plans.queries import (
    _BREAKS, _QUARTERLY, _RUN, CORR, FIRST, LAST, LONG, MONEY, REC, SOURCES, correlation_robustness, long, members, metrics, nations, quarterly, query, rank_correlations, records, spread, table, _INDEX, _MEMBERS,
)

# --- panels with records that are not eligible, and a physical measure -----

_NARROW = f"{REC}, el AS (SELECT rec.* FROM rec JOIN nation ON entity = n_name WHERE n_regionkey <> 0 AND period BETWEEN {FIRST + 12} AND {LAST - 12})"


@query(f"""WITH {_NARROW}, sk AS (SELECT n_name AS entity, CAST(p AS INTEGER) AS period, source FROM nation, range({FIRST + 12}, {LAST - 11}) t(p), (SELECT unnest({list(SOURCES)}) AS source) WHERE n_regionkey <> 0),
  ce AS (SELECT entity, period, source, count(*) AS record_count, count(amount) AS known_count, {MONEY.format('amount')} AS total FROM el GROUP BY ALL)
SELECT sk.entity, sk.period, sk.source, coalesce(record_count, 0) AS record_count, coalesce(known_count, 0) AS known_count, total FROM sk LEFT JOIN ce USING (entity, period, source)""")
def panel_long_narrow(spark, d):
    """Fewer entities and periods than records have."""
    known = table(spark, d, "nation").filter("n_regionkey <> 0").select(F.col("n_name").alias("entity"))
    return panel.long_panel(records(spark, d), known, SOURCES, FIRST + 12, LAST - 12)


@query(f"""WITH {REC} SELECT entity, period, round(sum(CASE WHEN record_id % 3 <> 0 THEN record_id / 8.0 END) FILTER (source = '1-URGENT'), 6) AS urgent_mw, round(sum(CASE WHEN record_id % 3 <> 0 THEN record_id / 8.0 END) FILTER (source = '5-LOW'), 6) AS low_mw FROM rec GROUP BY ALL""")
def panel_metric_sums(spark, d):
    measured = records(spark, d).withColumn("metric_value", F.when(F.col("record_id") % 3 != 0, F.col("record_id") / 8))
    return panel.metric_columns(measured, ["entity", "period"], {"1-URGENT": "urgent_mw", "5-LOW": "low_mw"})


_FUNDS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(f"WITH {REC} SELECT entity, " + ", ".join(f"""CAST(sum(CAST(amount AS DECIMAL(18, 2))) FILTER (source = '{s}' AND fund = '{f}') AS DOUBLE) AS "{s}_{f}_usd\"""" for s in SOURCES for f in _FUNDS) + " FROM rec GROUP BY entity")
def panel_fund_columns_found(spark, d):
    """The columns come from the pairs that the records have."""
    return panel.fund_columns(records(spark, d), ["entity"])


@query("SELECT a.n_name AS left_name, CASE WHEN {l} IN ('codf', 'cla', 'cgef') AND {r} IN ('codf', 'cla', 'cgef') THEN 'likely_shared_lineage' WHEN {l} IN ('aiddata', 'chapo') AND {r} IN ('aiddata', 'chapo') AND {l} <> {r} THEN 'documented_cross_reference_overlap' ELSE 'distinct_source_comparison' END AS lineage, CASE WHEN abs(a.n_nationkey / 100.0 - 0.1) <= 0.05 THEN 'stable' WHEN abs(a.n_nationkey / 100.0 - 0.1) <= 0.15 THEN 'moderate_change' ELSE 'sensitive' END AS stability FROM nation a".format(
    l="['aiddata', 'chapo', 'codf', 'cla', 'cgef'][1 + a.n_nationkey % 5]", r="['aiddata', 'chapo', 'codf', 'cla', 'cgef'][1 + (a.n_nationkey // 5) % 5]"))
def lineage_labels(spark, d):
    names = F.array(*map(F.lit, ("aiddata", "chapo", "codf", "cla", "cgef")))
    k = F.col("n_nationkey")
    left, right = F.get(names, k % 5), F.get(names, (F.floor(k / 5) % 5).cast("int"))
    return table(spark, d, "nation").select(F.col("n_name").alias("left_name"), C.lineage(left, right).alias("lineage"), C.stability_band(k / 100 - 0.1).alias("stability"))


# --- the review queue and its rules ----------------------------------------

_LT = "CASE p_partkey % 6 WHEN 0 THEN p_name || ' dam lot ' || CAST(1 + p_size % 2 AS STRING) ELSE p_name || ' dam' END"
_RT = "CASE p_partkey % 6 WHEN 0 THEN p_name || ' dam lot 2' WHEN 1 THEN upper(p_name) || ' -- DAM' WHEN 2 THEN p_name || ' dam extension' ELSE p_name || ' & dam' END"
_RID = "CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey AS STRING) ELSE 'x' || CAST(p_partkey AS STRING) END"
_RSEC = "CASE p_partkey % 5 WHEN 0 THEN 'water' ELSE 'energy' END"
_RFUND = "CASE p_partkey % 7 WHEN 0 THEN 'grant' ELSE 'loan' END"
_RAMT = "CASE p_partkey % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice * 1.5 END"
_RBASIS = "CASE p_partkey % 11 WHEN 0 THEN 'constant' ELSE 'nominal' END"
_STATUS = "CASE p_partkey % 8 WHEN 0 THEN 'direct_reference' WHEN 1 THEN 'reviewed' ELSE 'needs_review' END"
_RGROUP = "CASE p_partkey % 9 WHEN 0 THEN 'g' || CAST(p_partkey AS STRING) ELSE 'h' || CAST(p_partkey AS STRING) END"


def _lots(e: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({e}), 'lot (\\d+)', 1)))"


def _plain(e: str) -> str:
    return f"trim(regexp_replace(replace(lower({e}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


_RATIO = f"CASE WHEN {_RBASIS} = 'nominal' AND {_RAMT} <> 0 THEN round(p_retailprice / ({_RAMT}), 6) END"
_RULED = f"""qu AS (SELECT 'a:' || p_partkey AS left_key, 'b:' || ({_RID}) AS right_key, len({_lots(_LT)}) > 0 AND len({_lots(_RT)}) > 0 AND {_lots(_LT)} <> {_lots(_RT)} AS clash, {_RSEC} <> 'energy' AS apart, {_RATIO} AS amount_ratio,
    {_RID} = CAST(p_partkey AS STRING) AS same_id, {_RFUND} = 'loan' AND {_RSEC} = 'energy' AS fits, {_plain(_LT)} = {_plain(_RT)} AS same_title FROM part WHERE {_STATUS} = 'needs_review' AND {_RGROUP} <> 'g' || p_partkey),
  hi AS (SELECT *, CASE WHEN clash THEN 'qualifier_conflict_check_separate_projects' WHEN apart THEN 'sector_conflict_check_context' ELSE 'title_similarity_check_same_project' END AS review_hint, coalesce(amount_ratio BETWEEN 0.98 AND 1.02, false) AS agrees FROM qu),
  ru AS (SELECT *, CASE WHEN clash THEN 'conflicting_project_component_identifier' WHEN same_id AND fits AND agrees THEN 'same_source_identifier_and_amount' WHEN same_title AND fits AND (agrees OR amount_ratio IS NULL) THEN 'exact_normalized_title_and_compatible_fields' WHEN apart THEN 'sector_conflict_requires_context' ELSE 'manual_evidence_required' END AS rule_id FROM hi)"""


def _pairs(spark, d):
    """(records, candidates): a pair of records per part."""
    p = table(spark, d, "part")
    one = lambda e: F.expr(e)
    side = lambda source, ident, title, amt, basis, fund, sector, group: p.select(F.concat(F.lit(f"{source}:"), one(ident)).alias("record_key"), F.lit(source).alias("source"), one(ident).alias("record_id"), one(title).alias("title"), one(amt).alias("amount"), one(basis).alias("price_basis"), F.lit("commitment").alias("amount_measure"), one(fund).alias("fund"), one(sector).alias("sector"), one(group).alias("project_match_id"))
    recs = side("a", "CAST(p_partkey AS STRING)", _LT, "p_retailprice", "'nominal'", "'loan'", "'energy'", "'g' || CAST(p_partkey AS STRING)").unionByName(side("b", _RID, _RT, _RAMT, _RBASIS, _RFUND, _RSEC, _RGROUP))
    cand = p.select(F.concat(F.lit("c"), "p_partkey").alias("candidate_id"), F.concat(F.lit("a:"), "p_partkey").alias("left_key"), F.concat(F.lit("b:"), one(_RID)).alias("right_key"), F.col("p_type").alias("entity"), F.col("p_size").alias("period"), (F.lit(0.75) + F.col("p_size") / 400).alias("similarity"), one(_STATUS).alias("status"))
    return recs, cand


def _queue(spark, d):
    recs, cand = _pairs(spark, d)
    return review.review_queue(cand, recs)


@query(f"WITH {_RULED} SELECT left_key, right_key, review_hint, CASE WHEN clash THEN 'different_project' END AS suggested_decision, CASE WHEN clash THEN 'high' ELSE 'low' END AS suggestion_confidence, amount_ratio FROM hi")
def review_hints(spark, d):
    return _queue(spark, d).select("left_key", "right_key", "review_hint", "suggested_decision", "suggestion_confidence", "amount_ratio")


@query(f"""WITH {_RULED}, su AS (SELECT *, rule_id IN ('conflicting_project_component_identifier', 'same_source_identifier_and_amount', 'exact_normalized_title_and_compatible_fields') AS auto_apply FROM ru)
SELECT left_key, right_key, rule_id, CASE WHEN clash THEN 'different_project' WHEN auto_apply THEN 'same_project' ELSE 'uncertain' END AS review_decision, CASE WHEN auto_apply THEN 'high' ELSE 'low' END AS confidence, auto_apply FROM su""")
def ruled_queue(spark, d):
    return review.recommend(_queue(spark, d)).select("left_key", "right_key", "rule_id", "review_decision", "confidence", "auto_apply")


@query(f"WITH {_RULED} SELECT left_key, right_key FROM hi WHERE review_hint = 'sector_conflict_check_context' AND (contains(left_key, '7') OR contains(right_key, '7'))")
def reviews_filtered(spark, d):
    queue = _queue(spark, d).drop("entity", "left_title", "right_title", "candidate_id").withColumns({c: F.lit("") for c in ("entity", "left_title", "right_title", "candidate_id")}).withColumn("review_decision", F.lit(None).cast("string"))
    return dashboards.filter_reviews(queue, "pending", "sector_conflict_check_context", " 7").select("left_key", "right_key")


# --- decisions applied, completed, audited ---------------------------------

_GROUP_OF = "'G' || CAST(c_custkey // 3 AS VARCHAR)"


def _applied(spark, d):
    """(records, candidates, decisions): customers in threes; decisions join groups in twos."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    name = lambda x: F.concat(F.lit("c"), F.lpad(x.cast("string"), 8, "0"))
    recs = c.select(name(F.col("k")).alias("record_key"), F.concat(F.lit("G"), F.floor(F.col("k") / 3)).alias("project_match_id"), F.lit("needs_review").alias("match_status"), F.lit(0.8).alias("match_confidence"))
    ends = c.filter((F.col("k") % 6 == 0)).select(F.col("k"), F.concat(F.lit("d"), "k").alias("candidate_id"), name(F.col("k")).alias("left_key"), name(F.col("k") + 3).alias("right_key"))
    cand = ends.filter("k % 5 <> 0").select("candidate_id", "left_key", "right_key")
    said = F.when(F.col("k") % 4 == 0, "same_project").when(F.col("k") % 7 == 0, "perhaps").otherwise("different_project")
    return recs, cand, ends.select("candidate_id", said.alias("review_decision"))


_AP = f"""me AS (SELECT c_custkey AS k, 'c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS record_key, {_GROUP_OF} AS g FROM customer),
  de AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'candidate_not_found' WHEN k % 4 <> 0 AND k % 7 = 0 THEN 'invalid_decision' ELSE 'applied' END AS st, k % 4 = 0 AS same FROM me WHERE k % 6 = 0),
  jo AS (SELECT k FROM de WHERE st = 'applied' AND same AND EXISTS (SELECT 1 FROM me WHERE me.k = de.k + 3)),
  tagged AS (SELECT me.*, (me.k // 6) * 6 IN (SELECT k FROM jo) AS joined, CASE WHEN (me.k // 6) * 6 IN (SELECT k FROM jo) THEN 'J' || (me.k // 6) ELSE g END AS root FROM me),
  gr AS (SELECT root, count(*) AS n, 'PM-' || upper(substr(sha1(string_agg(record_key, '|' ORDER BY record_key)), 1, 14)) AS pm FROM tagged GROUP BY root)"""


@query(f"""WITH {_AP} SELECT record_key, CASE WHEN n > 1 THEN pm ELSE g END AS project_match_id, CASE WHEN joined AND k % 3 = 0 THEN 'human_confirmed' ELSE 'needs_review' END AS match_status, CAST(CASE WHEN joined AND k % 3 = 0 THEN 1.0 ELSE 0.8 END AS DOUBLE) AS match_confidence FROM tagged JOIN gr USING (root)""")
def applied_records(spark, d):
    recs, _ = review.apply_decisions(*_applied(spark, d))
    return recs.select("record_key", "project_match_id", "match_status", "match_confidence")


@query(f"WITH {_AP} SELECT 'd' || k AS candidate_id, st AS application_status FROM de")
def application_status(spark, d):
    _, done = review.apply_decisions(*_applied(spark, d))
    return done.select("candidate_id", "application_status")


def _audited(spark, d):
    """Decisions about customers in triples k, k + 1, k + 2, with planted faults."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    k = F.col("k")
    first = c.filter("k % 3 = 0")
    row = lambda df, name, a, b, said: df.select("k", F.concat(F.lit(name), "k").alias("candidate_id"), F.concat(F.lit("c"), k + a).alias("left_key"), F.concat(F.lit("c"), k + b).alias("right_key"), said.alias("review_decision"))
    same, apart = F.lit("same_project"), F.lit("different_project")
    made = row(first, "s", 0, 1, same).unionByName(row(first, "t", 1, 2, F.when(k % 21 == 0, "uncertain").otherwise(same))).unionByName(row(first.filter("k % 5 = 0"), "x", 2, 0, apart)).unionByName(row(first.filter("k % 15 = 6"), "o", 1, 0, apart))
    made = made.unionByName(made.filter("candidate_id like 's%' and k % 27 = 0"))
    cand = made.dropDuplicates(["candidate_id"]).filter("not (candidate_id like 's%' and k % 33 = 0)").select("candidate_id", "left_key", F.when(F.col("candidate_id").startswith("t") & (k % 39 == 0), "c0").otherwise(F.col("right_key")).alias("right_key"), F.lit("needs_review").alias("status"))
    cand = cand.unionByName(first.filter("k % 45 = 0").select(F.concat(F.lit("n"), "k").alias("candidate_id"), F.lit("c1").alias("left_key"), F.lit("c2").alias("right_key"), F.lit("needs_review").alias("status")))
    ents = c.filter("k % 50 <> 0").select(F.when(k % 3 == 2, F.concat(F.lit("E"), k)).otherwise(F.concat(F.lit("F"), F.floor(k / 3))).alias("project_entity_id"), F.concat(F.lit("c"), "k").alias("record_key"))
    ents = ents.unionByName(c.filter("k % 77 = 0").select(F.concat(F.lit("Z"), "k").alias("project_entity_id"), F.concat(F.lit("c"), "k").alias("record_key")))
    done = made.dropDuplicates(["candidate_id"]).filter("k % 51 <> 0").select("candidate_id", F.when(k % 57 == 0, "different_project").otherwise(F.col("review_decision")).alias("review_decision"), F.when(k % 63 == 0, "invalid_decision").otherwise("applied").alias("application_status"))
    done = done.unionByName(first.filter("k % 69 = 0").select(F.concat(F.lit("y"), "k").alias("candidate_id"), same.alias("review_decision"), F.lit("applied").alias("application_status")))
    seen = made.dropDuplicates(["candidate_id"]).filter("k % 75 <> 0").select("candidate_id", F.when(k % 81 == 0, "uncertain").otherwise(F.col("review_decision")).alias("review_decision"), F.when(k % 87 == 0, " Low ").otherwise("high").alias("confidence"), F.when(k % 93 == 0, "Possibly the same").otherwise("clear").alias("rule_evidence"))
    seen = seen.unionByName(first.filter("k % 99 = 0").select(F.concat(F.lit("z"), "k").alias("candidate_id"), same.alias("review_decision"), F.lit("high").alias("confidence"), F.lit("").alias("rule_evidence")))
    return made.drop("k"), cand, ents, done, seen


_AU = """k0 AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer), f AS (SELECT k FROM k0 WHERE k % 3 = 0),
  m0 AS (SELECT k, 's' || k AS id, k AS l, k + 1 AS r, 'same_project' AS said FROM f UNION ALL SELECT k, 't' || k, k + 1, k + 2, CASE WHEN k % 21 = 0 THEN 'uncertain' ELSE 'same_project' END FROM f
    UNION ALL SELECT k, 'x' || k, k + 2, k, 'different_project' FROM f WHERE k % 5 = 0 UNION ALL SELECT k, 'o' || k, k + 1, k, 'different_project' FROM f WHERE k % 15 = 6),
  ca AS (SELECT id, 'c' || l AS l, CASE WHEN id LIKE 't%' AND k % 39 = 0 THEN 'c0' ELSE 'c' || r END AS r FROM m0 WHERE NOT (id LIKE 's%' AND k % 33 = 0)),
  en AS (SELECT CASE WHEN k % 3 = 2 THEN 'E' || k ELSE 'F' || (k // 3) END AS e, k FROM k0 WHERE k % 50 <> 0 UNION ALL SELECT 'Z' || k, k FROM k0 WHERE k % 77 = 0),
  ho AS (SELECT k, count(DISTINCT e) AS n, min(e) AS e FROM en GROUP BY k),
  pa AS (SELECT m0.*, a.e AS el, b.e AS er FROM m0 LEFT JOIN ho a ON l = a.k LEFT JOIN ho b ON r = b.k),
  ap AS (SELECT k, id, CASE WHEN k % 57 = 0 THEN 'different_project' ELSE said END AS said, CASE WHEN k % 63 = 0 THEN 'invalid_decision' ELSE 'applied' END AS st FROM m0 WHERE k % 51 <> 0),
  au AS (SELECT k, id, CASE WHEN k % 81 = 0 THEN 'uncertain' ELSE said END AS said FROM m0 WHERE k % 75 <> 0)"""


@query(f"""WITH {_AU}, fo AS (
  SELECT 'error' AS severity, 'duplicate_candidate_id' AS "check", id AS key FROM m0 WHERE id LIKE 's%' AND k % 27 = 0 UNION ALL SELECT 'error', 'invalid_decision', id FROM m0 WHERE said = 'uncertain'
  UNION ALL SELECT 'error', 'unknown_candidate', id FROM m0 WHERE id LIKE 's%' AND k % 33 = 0 UNION ALL SELECT 'error', 'endpoint_mismatch', id FROM m0 WHERE id LIKE 't%' AND k % 39 = 0
  UNION ALL SELECT 'error', 'missing_applied_row', id FROM m0 WHERE k % 51 = 0 UNION ALL SELECT 'error', 'decision_not_applied', id FROM ap WHERE st <> 'applied' UNION ALL SELECT 'error', 'applied_decision_mismatch', ap.id FROM ap JOIN m0 USING (id) WHERE ap.said <> m0.said
  UNION ALL SELECT 'error', 'opposing_decisions_for_pair', id FROM m0 WHERE id LIKE 's%' AND k % 15 = 6
  UNION ALL SELECT 'error', 'transitive_contradiction', id FROM m0 WHERE id LIKE 'x%' AND k % 21 <> 0 UNION ALL SELECT 'error', 'transitive_contradiction', id FROM m0 WHERE id LIKE 'o%'
  UNION ALL SELECT 'error', 'record_in_several_entities', 'c' || k FROM ho WHERE n > 1
  UNION ALL SELECT DISTINCT 'error', 'record_missing_from_index', 'c' || u FROM (SELECT l AS u FROM m0 UNION SELECT r FROM m0) WHERE u NOT IN (SELECT k FROM ho)
  UNION ALL SELECT 'error', 'same_project_split', id FROM pa WHERE said = 'same_project' AND el <> er UNION ALL SELECT 'error', 'different_project_collapsed', id FROM pa WHERE said = 'different_project' AND el = er
  UNION ALL SELECT 'warning', 'extra_applied_row', 'y' || k FROM f WHERE k % 69 = 0 UNION ALL SELECT 'warning', 'candidate_without_decision', 'n' || k FROM f WHERE k % 45 = 0
  UNION ALL SELECT 'error', 'missing_audit_row', id FROM m0 WHERE k % 75 = 0 UNION ALL SELECT 'error', 'audit_decision_mismatch', au.id FROM au JOIN m0 USING (id) WHERE au.said <> m0.said
  UNION ALL SELECT 'warning', 'extra_audit_row', 'z' || k FROM f WHERE k % 99 = 0 UNION ALL SELECT 'warning', 'doubt_in_note_or_confidence', id FROM m0 WHERE k % 75 = 0 OR k % 87 = 0 OR k % 93 = 0)
SELECT DISTINCT * FROM fo""")
def audit_findings(spark, d):
    return review.audit(*_audited(spark, d))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), x AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'q' || user_id ELSE '' END AS q, user_id % 5 <> 0 AS in_queue, 'p' || user_id AS p, user_id % 3 <> 0 AS in_prior FROM u)
SELECT CAST(user_id AS VARCHAR) AS candidate_id, 'same_project' AS review_decision, coalesce(CASE WHEN in_queue THEN nullif(q, '') END, CASE WHEN in_prior THEN p END, '') AS left_title, CASE WHEN in_queue THEN CAST(user_id % 7 AS VARCHAR) WHEN in_prior THEN '1' ELSE '' END AS period FROM x""")
def audit_rows(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    k = F.col("user_id")
    wide = lambda df, title, period: df.select(k.cast("string").alias("candidate_id"), *(F.lit("").alias(c) for c in review.CONTEXT if c not in ("left_title", "period")), title.alias("left_title"), period.alias("period"))
    queue = wide(u.filter("user_id % 5 <> 0"), F.when(k % 2 == 0, F.concat(F.lit("q"), k)).otherwise(""), k % 7)
    prior = wide(u.filter("user_id % 3 <> 0"), F.concat(F.lit("p"), k), F.lit(1))
    return review.audit_table(u.select(k.cast("string").alias("candidate_id"), F.lit("same_project").alias("review_decision")), queue, prior).select("candidate_id", "review_decision", "left_title", "period")


_NOTE = "CASE event_id % 6 WHEN 0 THEN 'AUTO_REVIEW rule_a : text' WHEN 1 THEN 'BATCH_REVIEW rule_b: more: text' WHEN 2 THEN 'ASSISTANT_REVIEW c d: x' WHEN 3 THEN 'HUMAN_REVIEW imported' WHEN 4 THEN '' ELSE 'said AUTO_REVIEW x: y' END"


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'auto_prior' WHEN 1 THEN 'batch' WHEN 2 THEN 'assistant' WHEN 3 THEN 'human' ELSE 'existing' END AS origin,
  CASE event_id % 6 WHEN 0 THEN 'rule_a' WHEN 1 THEN 'rule_b' WHEN 2 THEN 'c d' WHEN 3 THEN 'imported_human_decision' ELSE 'preserved_existing_decision' END AS rule FROM events""")
def decision_origins(spark, d):
    origin, rule = batch_review.origin_of(F.expr(_NOTE))
    return table(spark, d, "events").select("event_id", origin.alias("origin"), rule.alias("rule"))


# --- components whose answer needs no recursion ----------------------------


def _catalogued(spark, d):
    """Parts in five catalogues; ids repeat from catalogue to catalogue."""
    names = F.array(*map(F.lit, ("aiddata", "chapo", "cla", "codf", "cofi")))
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"))
    source, ident = F.get(names, (F.col("k") % 5).cast("int")), F.floor(F.col("k") / 5).cast("string")
    return p.select(F.concat_ws(":", source, ident).alias("record_key"), source.alias("source"), ident.alias("record_id"), F.concat(F.lit("G"), F.floor(F.col("k") / 4)).alias("project_match_id"))


_CAT = "ct AS (SELECT p_partkey AS k, ['aiddata', 'chapo', 'cla', 'codf', 'cofi'][1 + p_partkey % 5] AS source, CAST(p_partkey // 5 AS VARCHAR) AS id, ['aiddata', 'chapo', 'cla', 'codf', 'cofi'][1 + p_partkey % 5] || ':' || (p_partkey // 5) AS node FROM part)"


@query(f"WITH {_CAT} SELECT node, min(node) OVER (PARTITION BY CASE WHEN source IN ('aiddata', 'chapo') THEN 'aid' ELSE 'finance' END, id) AS component FROM ct WHERE source <> 'cofi'")
def shared_id_components(spark, d):
    none = spark.createDataFrame([], "left_key string, right_key string")
    return batch_review.equivalences(_catalogued(spark, d), none)


@query(f"WITH {_CAT} SELECT node, min(node) OVER (PARTITION BY k // 4) AS component FROM ct")
def group_components(spark, d):
    none = spark.createDataFrame([], "left_key string, right_key string")
    return batch_review.entities(_catalogued(spark, d), none)


# --- what titles say -------------------------------------------------------

_SAYS = "CASE p_partkey % 7 WHEN 0 THEN 'The ' || p_name || ' Hydro Dam Projects' WHEN 1 THEN p_name || ' bridges & roads' WHEN 2 THEN 'Loan for hospital supply of ' || p_name WHEN 3 THEN 'E-government network ' || p_size WHEN 4 THEN p_name || ' wind farm 2020' WHEN 5 THEN '' ELSE p_name || ' housing' END"
_WORDS = f"regexp_extract_all(regexp_replace(lower({_SAYS}), '\\be[\\s-]+government\\b', 'egovernment', 'g'), '[a-z0-9]+')"


@query(f"""WITH w AS (SELECT p_partkey, {_WORDS} AS ws FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(ws, lambda x: len(x) >= 4 AND NOT regexp_full_match(x, '\\d+') AND NOT list_contains({list(E.NO_ANCHORS)}, x)), lambda x: CASE WHEN len(x) > 5 AND ends_with(x, 's') THEN x[1:len(x) - 1] ELSE x END))), ' ') AS anchors,
  concat_ws('|', {", ".join(f"CASE WHEN regexp_matches(array_to_string(ws, ' '), '{p}') THEN '{f}' END" for f, p in E.FAMILIES.items())}) AS families FROM w""")
def anchors_and_families(spark, d):
    t = table(spark, d, "part").select("p_partkey", E.plain_words(F.expr(_SAYS)).alias("ws"))
    return t.select("p_partkey", F.array_join(E.anchors(F.col("ws")), " ").alias("anchors"), F.array_join(E.families(F.col("ws")), "|").alias("families"))


@query("""SELECT p_partkey, p_partkey % 5 <> 4 AND abs(p_size * 1e6 - p_size * 1e6 * (1 + (p_partkey % 5) / 50.0)) <= 0.03 * p_size * 1e6 * (1 + (p_partkey % 5) / 50.0) AS stated,
  p_partkey >= 10 AND p_partkey % 4 IN (0, 1) AS named, p_partkey % 3 = 1 OR p_partkey % 3 = 2 AS clash FROM part""")
def title_facts(spark, d):
    k = F.col("p_partkey")
    money = F.when(k % 5 == 4, "no sum").otherwise(F.concat(F.lit("Loan of USD "), "p_size", F.lit(" million")))
    record = F.when(k % 4 == 0, F.concat(F.lit("see ID #"), k)).when(k % 4 == 1, F.concat(F.lit("linked to record 7, "), k)).when(k % 4 == 2, F.concat(F.lit("id 9"), k)).otherwise(F.concat(F.lit("number "), k))
    left = F.when(k % 3 == 1, "Doses of May, 2 million doses").otherwise("Phase II of June")
    right = F.when(k % 3 == 1, "Doses of May, 3 million doses").when(k % 3 == 2, "Phase III of June").otherwise("second phase of June")
    return spread(table(spark, d, "part"), "p_partkey").select("p_partkey", E.states_usd(money, F.col("p_size") * 1e6 * (1 + (k % 5) / 50)).alias("stated"), E.names_record(record, k.cast("string")).alias("named"), E.events_clash(left, right).alias("clash"))


# --- published order -------------------------------------------------------


@query(f"""WITH q AS (SELECT 'c' || p_partkey AS candidate_id, 0.75 + p_size / 400 AS similarity FROM part) SELECT candidate_id, row_number() OVER (ORDER BY similarity DESC, candidate_id) AS position FROM q""")
def candidates_in_order(spark, d):
    _, cand = _pairs(spark, d)
    return publish.numbered(cand.select("candidate_id", "similarity"), *publish.order_of("candidates")).select("candidate_id", "position")


@query(f"WITH {_INDEX} SELECT g AS project_match_id, row_number() OVER (ORDER BY entity, CAST(period AS VARCHAR), g) AS position FROM ix WHERE member_count > 1")
def groups_in_order(spark, d):
    return publish.numbered(matching.match_groups(members(spark, d)), *publish.order_of("groups")).select("project_match_id", "position")


@query("""WITH p AS (SELECT *, log10(value) AS lg FROM events WHERE value > 0), c AS (SELECT event_type, median(lg) AS centre FROM p GROUP BY event_type), m AS (SELECT event_type, median(abs(lg - centre)) AS mad FROM p JOIN c USING (event_type) GROUP BY event_type),
  j AS (SELECT event_id, value, CASE WHEN value > 0 THEN round(0.6745 * (log10(value) - centre) / mad, 4) END AS z FROM events JOIN c USING (event_type) JOIN m USING (event_type))
SELECT event_id AS outlier_id, row_number() OVER (ORDER BY abs(coalesce(z, 0)) DESC, event_id) AS position FROM j WHERE value <= 0 OR abs(z) > 3.5""")
def outliers_in_order(spark, d):
    found = stats.outliers(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value").withColumnRenamed("event_id", "outlier_id")
    return publish.numbered(found, *publish.order_of("outliers")).select("outlier_id", "position")


@query(f"WITH {LONG}, {CORR.format(m='metric', o='cr')} SELECT scope, left_metric, right_metric, row_number() OVER (ORDER BY abs(coalesce(spearman_rho, 0)) DESC, left_metric, right_metric, scope) AS position FROM cr")
def correlations_in_order(spark, d):
    return publish.numbered(rank_correlations(spark, d), *publish.order_of("correlations")).select("scope", "left_metric", "right_metric", "position")


@query(f"WITH {_QUARTERLY}, {_RUN}, {_BREAKS}, ex AS (SELECT series, no_break_bic - bic AS imp, CAST(unnest(range(1, len(b) + 1)) AS INTEGER) AS k FROM bm WHERE len(b) > 0) SELECT series, k AS break_number, row_number() OVER (ORDER BY round(imp, 6) DESC, series, k) AS position FROM ex")
def breakpoints_in_order(spark, d):
    points = quarterly(spark, d)
    return publish.numbered(breaks.breakpoints(points, breaks.mean_breaks(points)), *publish.order_of("breakpoints")).select("series", "break_number", "position")


@query("SELECT event_type, n, row_number() OVER (ORDER BY n DESC, first_seen) AS position FROM (SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY event_type)")
def types_most_common(spark, d):
    return publish.numbered(publish.most_common(table(spark, d, "events"), "event_type", "event_id"), *publish.order_of("most_common")).select("event_type", "n", "position")


# --- dashboards ------------------------------------------------------------

_OVER = f"{REC}, ov AS (SELECT entity, count(*) AS records, count(DISTINCT source) AS source_count FROM rec WHERE record_id % 4 = 0 OR source = '5-LOW' GROUP BY entity)"


def _overview(spark, d):
    return dashboards.entity_overview(records(spark, d).filter("record_id % 4 = 0 or source = '5-LOW'")).drop("by_source", "by_period")


@query(f"WITH {_OVER} SELECT entity, row_number() OVER (ORDER BY source_count DESC, records DESC, entity) AS position FROM ov")
def entities_by_sources(spark, d):
    return publish.numbered(_overview(spark, d), *dashboards.entity_order("sources")).select("entity", "position")


@query(f"WITH {_OVER} SELECT 'records' AS mode, entity, row_number() OVER (ORDER BY records DESC, entity) AS position FROM ov UNION ALL SELECT 'name', entity, row_number() OVER (ORDER BY replace(entity, '_', ' ')) FROM ov")
def entities_ranked(spark, d):
    """The orders by records and by name; the latter on names of one alphabet, accents are in the tests."""
    o = _overview(spark, d)
    of = lambda mode: publish.numbered(o, *dashboards.entity_order(mode)).select(F.lit(mode).alias("mode"), "entity", "position")
    return of("records").unionByName(of("name"))


@query(f"WITH {REC} SELECT entity FROM rec GROUP BY entity HAVING count(DISTINCT source) >= 5 AND contains(lower(entity), 'ion_1')")
def entities_filtered(spark, d):
    return dashboards.filter_entities(dashboards.rank_entities(dashboards.entity_overview(records(spark, d)), "name"), 5, " ION_1").select("entity")


_CATALOGUE = "ca AS (SELECT p_partkey, p_name AS name, p_brand AS short_name, p_type AS level, CASE WHEN p_partkey % 2 = 0 THEN 'debt' ELSE 'health' END AS category, CAST(p_size AS BIGINT) AS records, p_partkey % 54 AS countries, 1990 + p_size % 9 AS first, 2010 + p_size % 7 AS last FROM part)"


def _catalogue(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("short_name"), F.col("p_type").alias("level"), F.lit("").alias("amount_basis"), F.lit("").alias("description"), F.when(k % 2 == 0, "debt").otherwise("health").alias("category"), F.col("p_size").cast("long").alias("records"), (k % 54).alias("countries"), (1990 + F.col("p_size") % 9).alias("first"), (2010 + F.col("p_size") % 7).alias("last"))


@query(f"WITH {_CATALOGUE} SELECT p_partkey FROM ca WHERE category = 'debt' AND contains(lower(name || ' ' || short_name || ' ' || level), 'd brand')")
def catalogue_filtered(spark, d):
    return dashboards.filter_category(_catalogue(spark, d), "debt", "D Brand").select("p_partkey")


@query(f"WITH {_CATALOGUE} SELECT CAST(coalesce(sum(records), 0) AS BIGINT) AS records, coalesce(max(countries), 0) AS most_countries, min(first) AS first, max(last) AS last FROM ca WHERE category = 'health'")
def catalogue_totals(spark, d):
    return dashboards.catalogue_totals(dashboards.filter_category(_catalogue(spark, d), "health"))


@query(f"WITH {_CATALOGUE} SELECT CAST(0 AS BIGINT) AS records, CAST(0 AS BIGINT) AS most_countries, CAST(NULL AS INTEGER) AS first, CAST(NULL AS INTEGER) AS last")
def catalogue_totals_of_nothing(spark, d):
    return dashboards.catalogue_totals(dashboards.filter_category(_catalogue(spark, d), "none"))


@query(f"WITH {REC} SELECT count(DISTINCT entity) AS covered FROM rec WHERE source = '2-HIGH' AND period BETWEEN {FIRST} AND {FIRST + 3}")
def entities_covered(spark, d):
    return dashboards.covered_entities(records(spark, d).filter("source = '2-HIGH'"), FIRST, FIRST + 3)


@query(f"WITH {REC} SELECT entity, 'source' AS kind, source AS key, count(*) AS n FROM rec GROUP BY ALL UNION ALL SELECT entity, 'period', CAST(period AS VARCHAR), count(*) FROM rec GROUP BY ALL")
def entity_counts(spark, d):
    """The two maps of the overview, a row an entry."""
    o = dashboards.entity_overview(records(spark, d))
    entries = lambda kind: o.select("entity", F.lit(kind).alias("kind"), F.explode(f"by_{kind}").alias("key", "n"))
    return entries("source").unionByName(entries("period"))


@query(f"WITH {REC} SELECT entity, count(*) AS records, count(DISTINCT source) AS source_count, count(*) FILTER (source = '5-LOW') AS low FROM rec GROUP BY entity")
def payload_read(spark, d):
    """The JSON payload, parsed again."""
    payload = dashboards.overview_json(dashboards.entity_overview(records(spark, d)))
    read = F.from_json("payload", "records long, source_count long, by_source map<string,long>")
    return payload.select("entity", read.alias("r")).select("entity", "r.records", "r.source_count", F.coalesce(F.try_element_at("r.by_source", F.lit("5-LOW")), F.lit(0)).alias("low"))


# --- invariants ------------------------------------------------------------


@query("SELECT unnest(['wide_key_is_unique', 'wide_covers_skeleton', 'long_key_is_unique', 'long_is_balanced', 'missing_amount_is_not_zero', 'group_has_two_members', 'entities_cover_records', 'no_amount_across_sources', 'missingness_fills_panel']) AS \"check\", CAST(0 AS BIGINT) AS failures")
def panel_is_sound(spark, d):
    r = records(spark, d)
    # the records themselves in groups of three, the last ones alone
    text = lambda c: c.cast("string")
    grouped = r.select(text(F.floor(F.col("record_id") / 12)).alias("project_match_id"), "source", text(F.col("record_id")).alias("record_key"), "title", "entity", "period", F.lit("direct_reference").alias("match_status"))
    frame = panel.skeleton(nations(spark, d), FIRST, LAST)
    wide = panel.wide_panel(r, nations(spark, d), SOURCES, FIRST, LAST, [f"s{k}" for k in range(1, 6)])
    return publish.panel_checks(frame, wide, long(spark, d), r, matching.match_groups(grouped), matching.entity_index(grouped), panel.missingness(metrics(spark, d)), SOURCES)


@query(f"""WITH {REC}, cells AS (SELECT DISTINCT entity, period, source FROM rec), du AS (SELECT entity, period, source FROM rec GROUP BY ALL HAVING count(*) > 1), sk AS (SELECT count(*) AS n FROM nation, range({FIRST}, {LAST + 1}), range(5)),
  mem AS (SELECT CAST(floor(c_custkey / 3) AS BIGINT) AS g, count(*) AS n FROM customer GROUP BY 1)
SELECT 'long_key_is_unique' AS "check", (SELECT count(*) FROM du) AS failures UNION ALL SELECT 'long_is_balanced', (SELECT n FROM sk) - (SELECT count(*) FROM cells) UNION ALL SELECT 'missing_amount_is_not_zero', (SELECT count(*) FROM rec WHERE record_id % 10 = 0)
UNION ALL SELECT 'group_has_two_members', (SELECT count(*) FROM mem WHERE n < 2) UNION ALL SELECT 'entities_cover_records', CASE WHEN (SELECT count(*) FROM customer) <> (SELECT count(*) FROM orders) THEN 1 ELSE 0 END""")
def panel_faults(spark, d):
    """The same checks over records that are no panel: what they find."""
    r = records(spark, d).withColumns({"known_count": F.when(F.col("record_id") % 10 == 0, 0).otherwise(1), "total": F.lit(0.0)})
    full = panel.skeleton(nations(spark, d), FIRST, LAST).withColumn("source", F.explode(F.array(*map(F.lit, SOURCES))))
    index = matching.entity_index(members(spark, d))
    return publish.checks(
        publish.unique("long_key_is_unique", r, ["entity", "period", "source"]), publish.equal_sets("long_is_balanced", r, full, ["entity", "period", "source"]), publish.holds("missing_amount_is_not_zero", r.filter("known_count = 0"), F.col("total").isNull()),
        publish.holds("group_has_two_members", index, F.col("member_count") >= 2), publish.adds_up("entities_cover_records", index, F.col("member_count"), r),
    )


@query("SELECT unnest(['trend_key_is_unique', 'summary_key_is_unique', 'spearman_in_range', 'kendall_in_range', 'robustness_covers_correlations', 'lineage_is_known', 'model_key_is_unique', 'break_counts_agree', 'break_within_run']) AS \"check\", CAST(0 AS BIGINT) AS failures")
def statistics_are_sound(spark, d):
    m, points = metrics(spark, d), quarterly(spark, d)
    models = breaks.mean_breaks(points)
    return publish.statistics_checks(stats.period_trends(m, full_rows=4), stats.entity_summary(m), rank_correlations(spark, d), correlation_robustness(spark, d), models, breaks.breakpoints(points, models))


@query("SELECT 'orders_within_customers' AS \"check\", (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS failures UNION ALL SELECT 'customers_within_orders', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))")
def key_coverage(spark, d):
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return publish.checks(publish.within("orders_within_customers", o, c, ["k"]), publish.within("customers_within_orders", c, o, ["k"]))
