"""Queries of sources and sinks: raw files written from the part table, read back and standardised.

Every cell of the raw files is an expression that Spark and SQL both take, so
that the SQL of a query says what reading the files must give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions import clean as C
from panelweave.operators import publish
from panelweave.plans import build
from panelweave.plans.queries import _CELLS, _case, members, query, records, spread, table
from panelweave.plans.storage import durable, place
from panelweave.sources import adapters, files, legacy

KEY = "CAST(p_partkey AS STRING)"
YEAR = "CASE p_partkey % 4 WHEN 0 THEN 'FY2012/13' WHEN 1 THEN '1899' WHEN 2 THEN '' ELSE CAST(2000 + p_size % 20 AS STRING) END"
NAME = "CASE p_partkey % 5 WHEN 0 THEN 'Ivory Coast' WHEN 1 THEN ' KENYA ' WHEN 2 THEN 'Regional' WHEN 3 THEN 'Nowhere' ELSE '' END"
ISO = "CASE p_partkey % 5 WHEN 0 THEN ' ken ' WHEN 1 THEN 'AFR' WHEN 2 THEN 'CIV' WHEN 3 THEN 'XXX' ELSE '' END"
TITLE = "CASE p_partkey % 7 WHEN 0 THEN '' ELSE ' ' || p_name || ' & \"road\", lot ' || CAST(p_size AS STRING) END"
OTHER = "'Alt ' || p_brand"
FLOW = "CASE p_partkey % 5 WHEN 0 THEN 'Loan' WHEN 1 THEN 'Grant & aid' WHEN 2 THEN 'FDI equity' WHEN 3 THEN '' ELSE 'Other' END"
SECTOR = "CASE p_partkey % 4 WHEN 0 THEN 'Health' WHEN 1 THEN '' WHEN 2 THEN '210' ELSE 'zebra' END"
FLAG = "CASE p_partkey % 3 WHEN 0 THEN ' Yes' WHEN 1 THEN '0' ELSE '' END"
BANK = "CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'no' END"
REF = "CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey + 1 AS STRING) ELSE '' END"
PLACE = "CASE WHEN p_size % 3 = 0 THEN 'North' ELSE '' END"
DEBT_YEAR = "CASE WHEN p_partkey % 3 = 0 THEN '2011' ELSE '' END"
EQUITY_1 = "CASE p_partkey % 6 WHEN 0 THEN '5' WHEN 1 THEN '2.5' ELSE '' END"
EQUITY_2 = "CASE p_partkey % 4 WHEN 0 THEN '1' ELSE '' END"
LATITUDE = "CASE WHEN p_partkey % 2 = 0 THEN '1.5' ELSE '' END"
MONTH = "'201' || CAST(p_size % 10 AS STRING) || '-03'"
#: Cells of each raw file.
RAW = {
    "aiddata_africa_clean.csv": {"Country_of_Activity": NAME, "AidData_Record_ID": KEY, "Commitment_Year": YEAR, "Title": TITLE, "Clean_Amount_USD": _CELLS, "Flow_Type": FLOW, "Sector_Code": SECTOR},
    "bu_codf_africa_clean.csv": {"Is_Regional": FLAG, "国家": NAME, "贷款号": KEY, "年份": YEAR, "项目": TITLE, "Clean_Amount_USD": _CELLS, "行业": SECTOR, "能源类型": "'solar'"},
    "cla_africa_clean.csv": {"country_iso": ISO, "country_en_standard": NAME, "BU ID": KEY, "Year": YEAR, "Project Name": TITLE, "Loan_USD_M": _CELLS, "Sector": SECTOR, "Energy Source": "'solar'"},
    "cancellation_africa_clean.csv": {"ISO_A3": ISO, "Record_ID": KEY, "Year": YEAR, "Cancel_Amount_USD_Mn": _CELLS, "Is_Estimated": FLAG},
    "restructuring_africa_clean.csv": {"ISO_A3": ISO, "Record_ID": KEY, "Year_Numeric": YEAR, "Related_Projects": TITLE, "Description": OTHER, "Restructure_Amount_USD_Mn": _CELLS, "Type_of_Finance_Full": FLOW, "Is_Estimated": FLAG},
    "cofi_africa_clean.csv": {
        "country_iso3c": ISO, "unique_id": KEY, "debt_investment_amount_USD": _CELLS, "debt_investment_year": DEBT_YEAR, "equity_investor_amount_1_USD": EQUITY_1, "equity_investor_amount_2_USD": EQUITY_2, "equity_investment_year": "''", "commissioning_year": YEAR,
        "total_investment_amount_USD": "'77'", "investment_type_standard": FLOW, "power_plant_name": TITLE, "primary_fuel": SECTOR, "installed_capacity": "CAST(p_size AS STRING)", "latitude": LATITUDE, "longitude": "'2'",
    },
    "CGEF_Africa_2024_Cleaned.csv": {"国家": NAME, "贷款号": KEY, "年份": YEAR, "项目名称": TITLE, "贷款金额（百万美元）": _CELLS, "能源类型": SECTOR, "能源次级部门": "'wind'"},
    "CGP_Africa_2025_Cleaned.csv": {"国家": NAME, "CGP ID": KEY, "融资年份": YEAR, "投产年份": "'2019'", "发电厂名称": TITLE, "发电机组名称": OTHER, "产能 （兆瓦）": _CELLS, "投资类型": FLOW, "外国直接投资？": FLAG, "涉及中国开发性金融机构?": BANK, "技术": SECTOR, "州/省": PLACE, "BU_ID": REF},
    "chapo_africa_clean.csv": {"country_iso": ISO, "AidData_ID": KEY, "Commitment_Year": YEAR, "New_Short_Title": TITLE, "Short_Title": OTHER, "Amount_USD": _CELLS, "Description": OTHER, "Flow_Type": FLOW},
    "africa_aid_data_clean.csv": {"iso3c": ISO, "yearmonth": MONTH, "aid_total": _CELLS},
    "fdi_africa_panel.csv": {"ISO_A3": ISO, "Year": YEAR, "Flow_USD": _CELLS},
    "ihme_dah_africa_clean.csv": {"recipient_isocode": ISO, "year": YEAR, "dah_23_million": _CELLS},
    "china_africa_finance_cleaned.csv": {"CountryCode": ISO, "year": YEAR},
}
COUNTRIES = [("KEN", "Kenya", "肯尼亚", "1"), ("CIV", "Côte d'Ivoire", "科特迪瓦", "true"), ("SDN-H", "Sudan", "苏丹", "1")]


def raw_folder(spark, d, names=tuple(RAW)) -> str:
    """Folder with the raw files of the part table, in the shared folder."""
    base = place(spark, "raw")
    part = spread(table(spark, d, "part"), "p_partkey").sortWithinPartitions("p_partkey")  # a part file a task, in order of keys
    for name in names:
        cells = RAW[name]
        files.write_csv(part.select(*(F.expr(e).alias(c) for c, e in cells.items())), f"{base}/{name}", list(cells))
    files.write_csv(spark.createDataFrame(COUNTRIES, "ISO_A3 string, Country_EN string, Country_CN string, Is_Sovereign string"), f"{base}/fdi_africa_metadata.csv", ["ISO_A3", "Country_EN", "Country_CN", "Is_Sovereign"])
    return base


def _num(e: str) -> str:
    t = f"replace(trim({e}), ',', '')"
    return f"CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({t} AS DOUBLE) END"


def _year(e: str) -> str:
    return f"CAST(nullif(regexp_extract({e}, '((19|20)[0-9]{{2}})', 1), '') AS INTEGER)"


def _name(e: str) -> str:
    return f"CASE trim({e}) WHEN 'Ivory Coast' THEN 'CIV' WHEN 'KENYA' THEN 'KEN' WHEN 'Regional' THEN 'AFR' END"


def _iso(e: str) -> str:
    return f"nullif(upper(trim({e})), '')"


def _true(e: str) -> str:
    return f"(lower(trim({e})) IN ('1', 'true', 'yes', 'y'))"


def _norm(e: str) -> str:
    return f"trim(regexp_replace(replace(lower({e}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def _filled(*cells: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cells) + ", '')"


def _sector(raw: str, title: str) -> str:
    return _case(f"(' ' || {_norm(raw)} || ' ' || {_norm(title)} || ' ')", C.SECTORS, f"CASE WHEN {_norm(raw)} = '' THEN 'unspecified' ELSE 'other' END")


def _fund(flow: str, fallback: str = "unspecified") -> str:
    return _case(f"({_norm(flow)})", C.FUND_TYPES, f"'{fallback}'")


def _standard(source: str, entity: str, amount: str, title: str, where: str = "", ident: str = KEY, **other: str) -> str:
    """SELECT of the standard records of one source; other replaces what most sources share."""
    cells = {
        "record_key": f"'{source}:' || {ident}", "source": f"'{source}'", "record_id": ident, "entity": entity, "period": _year(YEAR), "period_basis": "'commitment_year'", "title": f"trim({title})", "description": "''",
        "amount": f"round({amount}, 6)", "price_basis": "'nominal_usd'", "amount_measure": "'loan_commitment'", "metric_value": "CAST(NULL AS DOUBLE)", "metric_unit": "CAST(NULL AS VARCHAR)", "flow_type_raw": "'Loan'", "fund": "'loan'", "sector_raw": "''",
        "sector": "'energy'", "geo_precision": "'country'", "is_estimated": "false", "refs": "''",
    } | other
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in cells.items()) + f" FROM part {where}"


_T, _TO = _filled(TITLE), _filled(TITLE, OTHER)
_SS = _filled(SECTOR, "'solar'")
_MILLIONS = f"({_num(_CELLS)}) * 1000000"
_EQUITY = f"CASE WHEN {_num(EQUITY_1)} IS NOT NULL OR {_num(EQUITY_2)} IS NOT NULL THEN coalesce({_num(EQUITY_1)}, 0) + coalesce({_num(EQUITY_2)}, 0) END"
_HAS_DEBT, _HAS_EQUITY = f"({_year(DEBT_YEAR)} IS NOT NULL OR {_num(_CELLS)} IS NOT NULL)", f"({_EQUITY}) IS NOT NULL"
_COFI = {
    "amount_measure": "'investment'", "metric_value": "CAST(p_size AS DOUBLE)", "metric_unit": "'MW'", "flow_type_raw": _filled(FLOW), "sector_raw": _filled(SECTOR, "'Energy'"),
    "geo_precision": f"CASE WHEN {_num(LATITUDE)} IS NOT NULL THEN 'coordinates' ELSE 'subnational' END",
}
_YEARLY = {"period_basis": "'loan_commitment_year'"}
_DEBT = {"period_basis": "'agreement_year'", "sector_raw": "'Debt'", "sector": "'debt'", "is_estimated": _true(FLAG)}
_LOADED = " UNION ALL ".join([
    _standard("aiddata", _name(NAME), _num(_CELLS), _T, price_basis="'constant_2023_usd'", amount_measure="'commitment'", flow_type_raw=_filled(FLOW), fund=_fund(FLOW), sector_raw=_filled(SECTOR), sector=_sector(SECTOR, _T)),
    _standard("codf", f"CASE WHEN {_true(FLAG)} THEN 'AFR' ELSE {_name(NAME)} END", _num(_CELLS), _T, sector_raw=_SS, sector=_sector(_SS, _T), **_YEARLY),
    _standard("cla", f"CASE WHEN upper(trim({ISO})) = 'AFR' THEN 'AFR' ELSE {_name(NAME)} END", _MILLIONS, _T, sector_raw=_SS, sector=_sector(_SS, _T), **_YEARLY),
    _standard("cancel", _iso(ISO), _MILLIONS, "'Debt cancellation'", amount_measure="'debt_cancellation'", flow_type_raw="'Debt cancellation'", fund="'debt_relief'", **_DEBT),
    _standard("restruct", _iso(ISO), _MILLIONS, _TO, description=OTHER, amount_measure="'debt_restructuring'", flow_type_raw=_filled(FLOW, "'Debt restructuring'"), **_DEBT),
    _standard("cofi", _iso(ISO), _num(_CELLS), _T, f"WHERE {_HAS_DEBT}", f"{KEY} || ':debt'", period=_year(DEBT_YEAR), period_basis="'debt_investment_year'", **_COFI),
    _standard("cofi", _iso(ISO), f"({_EQUITY})", _T, f"WHERE {_HAS_EQUITY}", f"{KEY} || ':equity'", period="CAST(NULL AS INTEGER)", period_basis="'equity_investment_year'", **(_COFI | {"fund": "'equity'"})),
    _standard("cofi", _iso(ISO), "77.0", _T, f"WHERE NOT {_HAS_DEBT} AND NOT {_HAS_EQUITY}", f"{KEY} || ':total'", period_basis="'commissioning_year_fallback'", **(_COFI | {"fund": _fund(FLOW)})),
    _standard("cgef", _name(NAME), _MILLIONS, _T, sector_raw=_filled(SECTOR, "'wind'"), **_YEARLY),
    _standard("cgp", _name(NAME), "CAST(NULL AS DOUBLE)", _TO, period=f"coalesce({_year(YEAR)}, 2019)", period_basis=f"CASE WHEN {_year(YEAR)} IS NOT NULL THEN 'financing_year' ELSE 'commissioning_year_fallback' END", price_basis="'not_applicable'", amount_measure="'capacity'",
        metric_value=_num(_CELLS), metric_unit="'MW'", flow_type_raw=_filled(FLOW), fund=f"CASE WHEN {_true(FLAG)} THEN 'equity' WHEN {_true(BANK)} THEN 'loan' ELSE 'unspecified' END", sector_raw=_filled(SECTOR),
        geo_precision=f"CASE WHEN {PLACE} <> '' THEN 'subnational' ELSE 'country' END", refs=f"CASE WHEN {REF} <> '' THEN 'cla:' || {REF} || '|cgef:' || {REF} ELSE '' END"),
    _standard("chapo", _iso(ISO), _num(_CELLS), _TO, description=OTHER, price_basis="'constant_2021_usd'", amount_measure="'commitment'", flow_type_raw=_filled(FLOW), fund=_fund(FLOW, "grant"), sector_raw="'Health'", sector="'health'", refs=f"'aiddata:' || {KEY}"),
])


@query(f"SELECT *, 'SRC-' || upper(substr(sha1(record_key), 1, 14)) AS project_match_id, amount IS NULL AS amount_missing, coalesce(entity = 'AFR', false) AS is_regional FROM ({_LOADED})")
def standard_records(spark, d):
    r = adapters.all_records(spark, raw_folder(spark, d))
    cols = "record_key source record_id entity period period_basis title description amount price_basis amount_measure metric_value metric_unit flow_type_raw fund sector_raw sector geo_precision is_estimated project_match_id amount_missing is_regional".split()
    return r.select(*cols, F.array_join("refs", "|").alias("refs"))


@query("SELECT unnest(['aiddata', 'codf', 'cla', 'cancel', 'restruct', 'cofi', 'cgef', 'cgp', 'chapo']) AS source, CAST(unnest(range(1, 10)) AS BIGINT) AS position")
def load_order(spark, d):
    r = adapters.all_records(spark, raw_folder(spark, d)).groupBy("source").agg(F.min("ordinal").alias("first"))
    return publish.numbered(r, "first").select("source", "position")


_SPEC = {"aiddata": (NAME, YEAR, _CELLS), "codf": (NAME, YEAR, _CELLS), "cla": (NAME, YEAR, _CELLS), "cgef": (NAME, YEAR, _CELLS), "cgp": (NAME, "'2019'", _CELLS), "exports": (ISO, MONTH, _CELLS), "fdi": (ISO, YEAR, _CELLS), "cofi": (ISO, YEAR, "'77'"), "chapo": (ISO, YEAR, _CELLS), "ihme": (ISO, YEAR, _CELLS), "china_eu_finance": (ISO, YEAR, "''")}
_LEGACY = "lg AS (" + " UNION ALL ".join(
    f"SELECT '{s.id}' AS source, '{s.label}' AS label, '{s.file}' AS file, trim({place}) AS place, {_iso(place) if s.by_iso else _name(place)} AS entity, {_year(year)} AS period, {_num(value)} AS value FROM part"
    for s in legacy.SPECS
    for place, year, value in [_SPEC.get(s.id, (ISO, YEAR, _CELLS))]
) + "), lm AS (SELECT *, coalesce(entity IN ('KEN', 'CIV'), false) AS mapped FROM lg)"


def _legacy(spark, d):
    folder = raw_folder(spark, d)
    return legacy.legacy_rows(spark, folder, files.read_csv(spark, f"{folder}/fdi_africa_metadata.csv"))


@query(f"WITH {_LEGACY} SELECT source, label, count(DISTINCT file) AS files, count(*) AS rows, count(*) FILTER (mapped) AS mapped_rows, count(value) FILTER (mapped) AS metric_known, min(period) FILTER (mapped) AS first, max(period) FILTER (mapped) AS last FROM lm GROUP BY ALL")
def legacy_audit(spark, d):
    return legacy.legacy_audit(_legacy(spark, d))


@query(f"WITH {_LEGACY} SELECT source, place, count(*) AS n FROM lm WHERE NOT mapped AND place <> '' GROUP BY ALL")
def legacy_unmapped(spark, d):
    return legacy.legacy_unmapped(_legacy(spark, d))


@query(f"WITH {_LEGACY} SELECT entity, source, count(*) AS records, round(coalesce(sum(value), 0), 6) AS value, count(value) AS known FROM lm WHERE mapped GROUP BY ALL")
def legacy_countries(spark, d):
    return legacy.legacy_countries(_legacy(spark, d))


_CODE = "CASE WHEN n_nationkey % 2 = 0 THEN '-99' ELSE upper(substr(n_name, 1, 3)) END"


@query(f"""SELECT CASE WHEN {_CODE} = '-99' THEN 'A' || n_nationkey ELSE {_CODE} END AS iso3, n_name AS name, '{{"type":"Point"}}' AS geometry FROM nation WHERE n_regionkey = 0""")
def features_read(spark, d):
    n = table(spark, d, "nation")
    props = F.struct(F.when(F.col("n_regionkey") == 0, "Africa").otherwise("Asia").alias("CONTINENT"), F.expr(_CODE).alias("ISO_A3"), F.concat(F.lit("A"), "n_nationkey").alias("ADM0_A3"), F.col("n_name").alias("NAME"))
    path = place(spark, "features")
    files.write_document({"features": n.select(props.alias("properties"), F.struct(F.lit("Point").alias("type")).alias("geometry"))}, path)
    return files.read_features(spark, path)


_DECISION = "CASE s_suppkey % 4 WHEN 0 THEN 'same_project' WHEN 1 THEN 'different_project' WHEN 2 THEN 'uncertain' ELSE 'maybe' END"


@query(f"""WITH x AS (SELECT CAST(s_suppkey // 3 AS VARCHAR) AS candidate_id, {_DECISION} AS review_decision, 'see "' || s_name || '", line' || chr(10) || s_suppkey AS review_notes, s_suppkey FROM supplier)
SELECT candidate_id, review_decision, review_notes FROM x WHERE review_decision <> 'maybe' QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY s_suppkey DESC) = 1""")
def decisions_imported(spark, d):
    s = table(spark, d, "supplier")
    made = s.select(F.floor(F.col("s_suppkey") / 3).cast("string").alias("candidate_id"), F.expr(_DECISION).alias("review_decision"), F.concat(F.lit('see "'), "s_name", F.lit('", line\n'), "s_suppkey").alias("review_notes"), "s_suppkey")
    path = place(spark, "decisions")
    files.export_decisions(made.orderBy("s_suppkey").coalesce(1), path)  # what one reviewer exports is one file
    return files.import_decisions(spark, path).select("candidate_id", "review_decision", "review_notes")


_DICTIONARY = {
    "master_panel_wide": ["iso3", "year", "cgp_capacity_mw", "aiddata_count", "cla_amount_known_count", "cofi_total_usd", "cofi_loan_usd", "strange"],
    "project_level_master": ["source_db", "project_match_id", "year"],
    "long_source": ["panel_id", "iso3", "amount_known_count"],
    "match_candidates": ["candidate_id", "left_record_key", "year"],
    "project_entity_index": ["project_entity_id", "member_count"],
    "panel_missingness": ["missing_rate", "panel_rows", "first_observed_year"],
}
#: Tables that stand for published ones, with the columns that they have.
_PUBLISHED = {"project_level_master": "orders", "long_fundtype": "lineitem", "match_review_queue": "supplier", "confirmed_match_groups": "events"}
_FOUND = " UNION ALL ".join(f"SELECT '{name}' AS \"table\", column_name AS column_ FROM (DESCRIBE SELECT * FROM {t})" for name, t in _PUBLISHED.items())
_MODULE = "CASE \"table\" WHEN 'project_level_master' THEN '项目级' WHEN 'long_fundtype' THEN '长面板' WHEN 'match_review_queue' THEN '项目匹配' ELSE '项目实体' END"


@query(f"""SELECT "table", column_ AS "column", {_MODULE} AS module, replace(column_, '_', ' ') AS description, CASE WHEN column_ LIKE '%year%' AND "table" <> 'project_level_master' THEN 'year' ELSE 'source-specific' END AS unit, '' AS key_role,
  CASE WHEN "table" = 'project_level_master' THEN 'source_missing_preserved; zero_is_observed' ELSE 'blank_when_not_observed; zero_is_observed' END AS missing_rule FROM ({_FOUND})
UNION ALL SELECT * FROM (VALUES
 ('master_panel_wide', 'iso3', '索引', 'ISO3 country code', 'text', 'composite_primary_key', 'not_missing'), ('master_panel_wide', 'year', '索引', 'Calendar year, restricted to 2000-2024', 'integer', 'composite_primary_key', 'not_missing'),
 ('master_panel_wide', 'cgp_capacity_mw', '特殊量纲', 'CGP generating-unit capacity assigned to financing year; commissioning year is fallback', 'MW', '', 'blank_when_not_observed; zero_is_observed'),
 ('master_panel_wide', 'aiddata_count', '记录与质量', 'Record or known-value count for aiddata', 'count', '', 'blank_when_not_observed; zero_is_observed'),
 ('master_panel_wide', 'cla_amount_known_count', '记录与质量', 'Record or known-value count for cla_amount_known', 'count', '', 'blank_when_not_observed; zero_is_observed'),
 ('master_panel_wide', 'cofi_total_usd', '项目库汇总', 'Source-specific annual amount for cofi; never add across sources', 'USD', '', 'blank_when_not_observed; zero_is_observed'),
 ('master_panel_wide', 'cofi_loan_usd', '资金性质', 'Source-specific fund-type amount: cofi_loan_usd', 'USD', '', 'blank_when_not_observed; zero_is_observed'), ('master_panel_wide', 'strange', '其他', 'strange', 'source-specific', '', 'blank_when_not_observed; zero_is_observed'),
 ('project_level_master', 'source_db', '项目级', 'source db', 'source-specific', 'composite_primary_key', 'source_missing_preserved; zero_is_observed'), ('project_level_master', 'project_match_id', '项目级', 'project match id', 'source-specific', 'entity_link', 'source_missing_preserved; zero_is_observed'),
 ('project_level_master', 'year', '项目级', 'year', 'source-specific', '', 'source_missing_preserved; zero_is_observed'), ('long_source', 'panel_id', '长面板', 'panel id', 'source-specific', 'panel_identifier', 'blank_when_not_observed; zero_is_observed'),
 ('long_source', 'iso3', '长面板', 'iso3', 'source-specific', 'composite_primary_key', 'blank_when_not_observed; zero_is_observed'), ('long_source', 'amount_known_count', '长面板', 'amount known count', 'count', '', 'blank_when_not_observed; zero_is_observed'),
 ('match_candidates', 'candidate_id', '项目匹配', 'candidate id', 'source-specific', 'primary_key', 'blank_when_not_observed; zero_is_observed'), ('match_candidates', 'left_record_key', '项目匹配', 'left record key', 'source-specific', 'foreign_key', 'blank_when_not_observed; zero_is_observed'),
 ('match_candidates', 'year', '项目匹配', 'year', 'year', '', 'blank_when_not_observed; zero_is_observed'), ('project_entity_index', 'project_entity_id', '项目实体', 'project entity id', 'source-specific', 'primary_key', 'blank_when_not_observed; zero_is_observed'),
 ('project_entity_index', 'member_count', '项目实体', 'member count', 'count', '', 'blank_when_not_observed; zero_is_observed'), ('panel_missingness', 'missing_rate', '质量诊断', 'missing rate', 'proportion_0_to_1', '', 'blank_when_not_observed; zero_is_observed'),
 ('panel_missingness', 'panel_rows', '质量诊断', 'panel rows', 'count', '', 'blank_when_not_observed; zero_is_observed'), ('panel_missingness', 'first_observed_year', '质量诊断', 'first observed year', 'year', '', 'blank_when_not_observed; zero_is_observed'))
 t("table", "column", module, description, unit, key_role, missing_rule)""")
def dictionary(spark, d):
    tables = {k: list(v) for k, v in _DICTIONARY.items()}
    for name, t in _PUBLISHED.items():
        tables.setdefault(name, []).extend(table(spark, d, t).columns)
    return files.data_dictionary(spark, tables).drop("position")


@query("""WITH st AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'human_confirmed' WHEN c_custkey % 5 = 0 THEN 'direct_reference' ELSE 'unmatched' END AS st FROM customer),
  ap AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'invalid_decision' ELSE 'applied' END AS a, CASE s_suppkey % 2 WHEN 0 THEN 'same_project' ELSE 'different_project' END AS r FROM supplier)
SELECT 'rows' AS section, 'orders' AS name, count(*) AS value FROM orders UNION ALL SELECT 'rows', 'part', count(*) FROM part UNION ALL SELECT 'matching', st, count(*) FROM st GROUP BY st UNION ALL SELECT 'applied', r, count(*) FROM ap WHERE a = 'applied' GROUP BY r""")
def build_report(spark, d):
    s = table(spark, d, "supplier")
    applied = s.select(F.when(F.col("s_suppkey") % 3 == 0, "invalid_decision").otherwise("applied").alias("application_status"), F.when(F.col("s_suppkey") % 2 == 0, "same_project").otherwise("different_project").alias("review_decision"))
    return publish.build_report({"orders": table(spark, d, "orders"), "part": table(spark, d, "part")}, members(spark, d), applied)


@query("SELECT n_nationkey, n_name, trim(n_name) AS same FROM nation WHERE n_nationkey >= 0")
def published_twice(spark, d):
    n = table(spark, d, "nation").withColumn("same", F.trim("n_name"))
    base = place(spark, "published")
    files.publish({"nation": n, "region": table(spark, d, "region")}, f"{base}/all", {"nation": ["n_nationkey", "n_name", "same"]}, f"{base}/public", ["nation"])
    return files.read_csv(spark, f"{base}/public/nation.csv").withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("SELECT n_nationkey, regexp_replace(replace(lower(n_name || ' & Co-' || n_nationkey), '&', ' and '), '[^a-z0-9]+', '', 'g') AS joined, (CASE n_nationkey % 3 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'y' ELSE 'no' END) IN (' TRUE ', 'y') AS flag FROM nation")
def names_joined(spark, d):
    flag = F.expr("CASE n_nationkey % 3 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'y' ELSE 'no' END")
    return table(spark, d, "nation").select("n_nationkey", C.norm_name(F.concat("n_name", F.lit(" & Co-"), "n_nationkey")).alias("joined"), C.truthy(flag).alias("flag"))


@query("""WITH rec AS (SELECT n_name AS entity, o_orderpriority AS source, year(o_orderdate) AS period, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT entity, CAST(sum(n) AS BIGINT) AS records, count(DISTINCT source) AS source_count, CAST(max(n) FILTER (source = '2-HIGH' AND period = 1996) AS BIGINT) AS high_1996, CAST(min(period) AS INTEGER) AS first FROM rec GROUP BY entity""")
def document_read(spark, d):
    """The entity document written as one JSON object and read back."""
    r = records(spark, d).withColumn("period", F.floor(F.col("period") / 12).cast("int"))
    by = r.groupBy("entity", "source", "period").agg(F.count("*").alias("n"))
    facts = r.groupBy("entity").agg(F.count("*").alias("records"), F.countDistinct("source").alias("source_count"), F.min("period").alias("first"))
    cells = by.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "source", "period").alias("k"), F.col("n").alias("v")))).alias("cells"))
    path = place(spark, "document")
    files.write_document({"entities": facts.join(cells, "entity").withColumn("cells", F.map_entries("cells"))}, path)
    doc = spark.read.schema("entities array<struct<entity:string,records:long,source_count:long,first:int,cells:array<struct<key:string,value:long>>>>").json(path).select(F.explode("entities").alias("e"))
    high = F.get(F.filter("e.cells", lambda c: c["key"] == "2-HIGH|1996"), F.lit(0))["value"]
    return doc.select("e.entity", "e.records", "e.source_count", high.alias("high_1996"), "e.first")


_BUILT = f"""al AS ({_LOADED}), el AS (SELECT * FROM al WHERE entity IN ('KEN', 'CIV') AND period BETWEEN 2000 AND 2024)"""


@query(f"""WITH {_BUILT}, sk AS (SELECT e AS entity, CAST(p AS INTEGER) AS period FROM (SELECT unnest(['KEN', 'CIV']) AS e), range(2000, 2025) t(p)),
  ce AS (SELECT entity, period, count(*) FILTER (source = 'cla') AS cla_count, CAST(sum(CAST(amount AS DECIMAL(18, 2))) FILTER (source = 'cla') AS DOUBLE) AS cla_total, count(*) FILTER (source = 'cgp') AS cgp_count, round(sum(metric_value) FILTER (source = 'cgp'), 6) AS cgp_capacity_mw, CAST(sum(CAST(amount AS DECIMAL(18, 2))) FILTER (source = 'cofi' AND fund = 'equity') AS DOUBLE) AS cofi_equity_usd,
    CAST(sum(CAST(amount AS DECIMAL(18, 2))) FILTER (source = 'chapo' AND fund = 'grant') AS DOUBLE) AS chapo_grant_usd FROM el GROUP BY ALL)
SELECT sk.entity, sk.period, coalesce(cla_count, 0) AS cla_count, cla_total, coalesce(cgp_count, 0) AS cgp_count, cgp_capacity_mw, cofi_equity_usd, chapo_grant_usd FROM sk LEFT JOIN ce USING (entity, period)""")
def built_wide_panel(spark, d):
    """The wide panel of standardised records: counts, totals, capacities and discovered fund columns."""
    folder = raw_folder(spark, d)
    entities = adapters.sovereign(files.read_csv(spark, f"{folder}/fdi_africa_metadata.csv"))
    recs = durable(adapters.all_records(spark, folder), "records")  # read by the counts, the capacities and, twice, the funds
    wide = build.panel_tables(recs, entities)["wide"]
    # a column is discovered only where some amount is known
    have = lambda c: F.col(c) if c in wide.columns else F.lit(None).cast("double").alias(c)
    return wide.select("entity", "period", "cla_count", "cla_total", "cgp_count", "cgp_capacity_mw", have("cofi_equity_usd"), have("chapo_grant_usd"))
