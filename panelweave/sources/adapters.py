"""Nine raw sources to one record table, each by a declared mapping.

A mapping says where the entity, period, title and amount stand in a file;
only one source needs more, its rows being several dated events.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.clean import amount, first_filled, fund_type, harmonize_sector, norm_text, parse_number, parse_year, stable_id, truthy
from panelweave.sources.files import read_csv, read_csv_ranges

MILLION = 1_000_000.0
#: Number of the row in its file, where there is one.
ROW = "__row"
RECORD_COLUMNS = (
    "project_match_id", "record_key", "source", "record_id", "entity", "period", "period_basis", "title", "description", "amount", "amount_unit", "price_basis", "amount_measure", "amount_missing",
    "metric_value", "metric_unit", "flow_type_raw", "fund", "sector_raw", "sector", "latitude", "longitude", "geo_precision", "is_regional", "is_estimated", "refs", "source_file",
)


@dataclass(frozen=True)
class Source:
    """Column names of one raw file; a tuple means the first that is filled."""

    name: str
    file: str
    record_id: str
    entity: str
    period: str | tuple[str, ...]
    title: str | tuple[str, ...]
    value: str | None
    price_basis: str
    measure: str
    by_iso: bool = False
    multiplier: float = 1.0
    period_basis: str = "commitment_year"
    flow: str | None = None
    flow_text: str = ""
    fund: str | None = None
    fund_fallback: str = "unspecified"
    sector: str | tuple[str, ...] = ()
    sector_label: str | None = None
    sector_text: str = ""
    regional: str | None = None
    estimated: str | None = None
    description: str | None = None
    metric: str | None = None
    refs: dict = field(default_factory=dict)


#: Columns of the raw files, in load order.
SOURCES = (
    Source("aiddata", "aiddata_africa_clean.csv", "AidData_Record_ID", "Country_of_Activity", "Commitment_Year", "Title", "Clean_Amount_USD", "constant_2023_usd", "commitment", flow="Flow_Type", sector="Sector_Code"),
    Source("codf", "bu_codf_africa_clean.csv", "贷款号", "国家", "年份", "项目", "Clean_Amount_USD", "nominal_usd", "loan_commitment", period_basis="loan_commitment_year", flow_text="Loan", fund="loan", sector=("行业", "能源类型"), regional="Is_Regional"),
    Source("cla", "cla_africa_clean.csv", "BU ID", "country_en_standard", "Year", "Project Name", "Loan_USD_M", "nominal_usd", "loan_commitment", multiplier=MILLION, period_basis="loan_commitment_year", flow_text="Loan", fund="loan", sector=("Sector", "Energy Source"), regional="country_iso"),
    Source("cancel", "cancellation_africa_clean.csv", "Record_ID", "ISO_A3", "Year", (), "Cancel_Amount_USD_Mn", "nominal_usd", "debt_cancellation", by_iso=True, multiplier=MILLION, period_basis="agreement_year", flow_text="Debt cancellation", fund="debt_relief", sector_label="debt", sector_text="Debt", estimated="Is_Estimated"),
    Source("restruct", "restructuring_africa_clean.csv", "Record_ID", "ISO_A3", "Year_Numeric", ("Related_Projects", "Description"), "Restructure_Amount_USD_Mn", "nominal_usd", "debt_restructuring", by_iso=True, multiplier=MILLION, period_basis="agreement_year", flow="Type_of_Finance_Full", flow_text="Debt restructuring", fund="loan", sector_label="debt", sector_text="Debt", estimated="Is_Estimated", description="Description"),
    Source("cofi", "cofi_africa_clean.csv", "unique_id", "country_iso3c", "commissioning_year", "power_plant_name", "total_investment_amount_USD", "nominal_usd", "investment", by_iso=True, flow="investment_type_standard", sector="primary_fuel", sector_label="energy", sector_text="Energy", metric="installed_capacity"),
    Source("cgef", "CGEF_Africa_2024_Cleaned.csv", "贷款号", "国家", "年份", "项目名称", "贷款金额（百万美元）", "nominal_usd", "loan_commitment", multiplier=MILLION, period_basis="loan_commitment_year", flow_text="Loan", fund="loan", sector=("能源类型", "能源次级部门"), sector_label="energy"),
    Source("cgp", "CGP_Africa_2025_Cleaned.csv", "CGP ID", "国家", ("融资年份", "投产年份"), ("发电厂名称", "发电机组名称"), None, "not_applicable", "capacity", period_basis="financing_year", flow="投资类型", sector="技术", sector_label="energy", metric="产能 （兆瓦）", refs={"cla": "BU_ID", "cgef": "BU_ID"}),
    Source("chapo", "chapo_africa_clean.csv", "AidData_ID", "country_iso", "Commitment_Year", ("New_Short_Title", "Short_Title"), "Amount_USD", "constant_2021_usd", "commitment", by_iso=True, flow="Flow_Type", fund_fallback="grant", sector_label="health", sector_text="Health", description="Description", refs={"aiddata": "AidData_ID"}),
)
COFI = next(s for s in SOURCES if s.name == "cofi")
#: Names that resolve to a code beside a country's own.
ALIASES = {
    "swaziland": "SWZ", "eswatini": "SWZ", "the gambia": "GMB", "gambia": "GMB", "cabo verde": "CPV", "cape verde": "CPV", "ivory coast": "CIV", "cote d ivoire": "CIV", "republic of the congo": "COG", "congo republic": "COG",
    "congo brazzaville": "COG", "democratic republic of the congo": "COD", "dr congo": "COD", "drc": "COD", "united republic of tanzania": "TZA", "tanzania": "TZA", "sao tome and principe": "STP", "regional africa": "AFR", "regional": "AFR", "区域性": "AFR",
}


def entity_names(metadata: DataFrame) -> DataFrame:
    """(name, code): normalised names of countries in both languages, aliases over them."""
    spark = metadata.sparkSession
    code = F.upper(F.trim("ISO_A3"))
    base = metadata.filter((code != "") & (code != "SDN-H"))
    names = [base.select(norm_text(F.coalesce(F.nullif(F.col(c), F.lit("")), "Country_EN", "ISO_A3")).alias("name"), code.alias("code"), F.lit(1).alias("rank")) for c in ("Country_EN", "Country_CN")]
    alias = spark.createDataFrame(sorted(ALIASES.items()), "name string, code string").withColumn("rank", F.lit(2))
    return reduce(DataFrame.unionByName, [*names, alias]).groupBy("name").agg(F.max_by("code", F.struct("rank", "code")).alias("code"))


def sovereign(metadata: DataFrame) -> DataFrame:
    code = F.upper(F.trim("ISO_A3"))
    return metadata.filter((code != "") & (code != "SDN-H") & truthy(F.col("Is_Sovereign"))).select(code.alias("entity")).distinct()


def _cell(df: DataFrame, name: str | Sequence[str] | None) -> Column:
    names = [name] if isinstance(name, str) else list(name or ())
    cells = [F.col(f"`{n}`") for n in names if n in df.columns]
    return first_filled(*cells) if cells else F.lit(None).cast("string")


def records_of(raw: DataFrame, s: Source, names: DataFrame) -> DataFrame:
    """Records of one source in RECORD_COLUMNS, with ordinal where raw has ROW. Codes are upper-cased but not checked; unknown names give NULL."""
    place = _cell(raw, s.entity)
    found = raw.withColumns({"__norm": norm_text(F.coalesce(place, F.lit(""))), "__title": F.coalesce(F.trim(_cell(raw, s.title)), F.lit("Debt cancellation" if s.name == "cancel" else "")), "__flow": F.coalesce(_cell(raw, s.flow), F.lit(s.flow_text))})
    found = found.join(names.select(F.col("name").alias("__norm"), F.col("code").alias("__code")), "__norm", "left")
    entity = F.nullif(F.upper(F.trim(place)), F.lit("")) if s.by_iso else F.col("__code")
    if s.regional:
        flag = _cell(raw, s.regional)
        entity = F.when(truthy(flag) | (F.upper(F.trim(flag)) == "AFR"), "AFR").otherwise(entity)
    value = amount(parse_number(_cell(raw, s.value)), s.multiplier)
    sector_raw = F.coalesce(_cell(raw, s.sector), F.lit(s.sector_text))
    kind = F.lit(s.fund) if s.fund else fund_type(norm_text("__flow"), s.fund_fallback)
    if s.name == "cgp":
        kind = F.when(truthy(_cell(raw, "外国直接投资？")), "equity").when(truthy(_cell(raw, "涉及中国开发性金融机构?")), "loan").otherwise("unspecified")
    periods = [s.period] if isinstance(s.period, str) else s.period
    years = [parse_year(_cell(raw, p)) for p in periods]
    basis = F.when(years[0].isNotNull() | F.lit(len(years) == 1), s.period_basis).otherwise("commissioning_year_fallback")
    refs = [F.when(F.trim(_cell(raw, c)) != "", F.concat(F.lit(f"{target}:"), F.trim(_cell(raw, c)))) for target, c in s.refs.items()]
    ident = F.coalesce(_cell(raw, s.record_id), F.lit(""))
    key = F.concat(F.lit(f"{s.name}:"), ident)
    cols = {
        "project_match_id": stable_id("SRC", key), "record_key": key, "source": F.lit(s.name), "record_id": ident, "entity": entity, "period": F.coalesce(*years), "period_basis": basis, "title": F.col("__title"),
        "description": F.coalesce(_cell(raw, s.description), F.lit("")), "amount": value, "amount_unit": F.lit("USD"), "price_basis": F.lit(s.price_basis), "amount_measure": F.lit(s.measure), "amount_missing": value.isNull(),
        "metric_value": parse_number(_cell(raw, s.metric)), "metric_unit": F.lit("MW" if s.metric else None).cast("string"), "flow_type_raw": F.col("__flow"), "fund": kind, "sector_raw": sector_raw,
        "sector": F.lit(s.sector_label) if s.sector_label else harmonize_sector(norm_text(sector_raw), norm_text("__title")), "latitude": parse_number(_cell(raw, "latitude")), "longitude": parse_number(_cell(raw, "longitude")),
        "geo_precision": F.lit("country"), "is_regional": F.coalesce(entity == "AFR", F.lit(False)), "is_estimated": truthy(_cell(raw, s.estimated)), "refs": F.array_compact(F.array(*refs)) if refs else F.array().cast("array<string>"), "source_file": F.lit(s.file),
    }
    if s.name == "cgp":
        cols["geo_precision"] = F.when(_cell(raw, "州/省").isNotNull(), "subnational").otherwise("country")
    if ROW in raw.columns:
        # two events of one row follow each other
        cols["ordinal"] = F.col(ROW) * 4 + (F.col("__place") if "__place" in raw.columns else F.lit(0))
    return found.select(*(c.alias(n) for n, c in cols.items()))


def dated_events(raw: DataFrame) -> DataFrame:
    """One row per event of an investment: debt, equity, or the total where neither has a year or amount.

    Equity is the sum of two amounts, NULL only if both are.
    """
    one, two = (parse_number(_cell(raw, f"equity_investor_amount_{k}_USD")) for k in (1, 2))
    equity = F.when(one.isNotNull() | two.isNotNull(), F.coalesce(one, F.lit(0.0)) + F.coalesce(two, F.lit(0.0)))
    debt = parse_number(_cell(raw, "debt_investment_amount_USD"))
    event = lambda name, year, value: F.struct(F.lit(name).alias("name"), parse_year(_cell(raw, year)).alias("year"), value.alias("value"))
    some = F.filter(F.array(event("debt", "debt_investment_year", debt), event("equity", "equity_investment_year", equity)), lambda e: e["year"].isNotNull() | e["value"].isNotNull())
    total = F.array(event("total", "commissioning_year", parse_number(_cell(raw, "total_investment_amount_USD"))))
    return raw.select("*", F.posexplode(F.when(F.size(some) > 0, some).otherwise(total)).alias("__place", "event"))


def cofi_records(raw: DataFrame, names: DataFrame) -> DataFrame:
    events = dated_events(raw).withColumn("unique_id", F.concat(F.coalesce(_cell(raw, "unique_id"), F.lit("")), F.lit(":"), F.col("event.name")))
    events = events.withColumns({"commissioning_year": F.col("event.year").cast("string"), "total_investment_amount_USD": F.col("event.value").cast("string"), "__event": F.col("event.name")})
    base = records_of(events, COFI, names)
    name = F.element_at(F.split("record_id", ":"), -1)
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return base.withColumns({
        "period_basis": F.when(name == "total", "commissioning_year_fallback").otherwise(F.concat(name, F.lit("_investment_year"))),
        "fund": F.when(name == "debt", "loan").when(name == "equity", "equity").otherwise(F.col("fund")),
        "geo_precision": F.when(placed, "coordinates").otherwise("subnational"),
    })


def all_records(spark: SparkSession, folder: str, ranges: bool = False) -> DataFrame:
    """Records of all nine sources, with ordinal as load order: by source, then by row of its file.

    Cells may have several lines, so a file is read in one piece, which suits
    small ones, and a folder of part files has its rows in order within each
    part. With ranges, for large files, each is read by many tasks, and rows are
    in order over all parts; the records are the same.
    """
    names = entity_names(read_csv(spark, f"{folder}/fdi_africa_metadata.csv"))
    parts = []
    for rank, s in enumerate(SOURCES):
        path = f"{folder}/{s.file}"
        raw = read_csv_ranges(spark, path, ordinal=ROW) if ranges else read_csv(spark, path).withColumn(ROW, F.monotonically_increasing_id())
        parts.append((cofi_records if s.name == "cofi" else partial(records_of, s=s))(raw, names=names).withColumn("ordinal", F.lit(rank) * F.lit(1 << 56) + F.col("ordinal")))
    return reduce(DataFrame.unionByName, parts)
