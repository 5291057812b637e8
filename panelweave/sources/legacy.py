"""The older dashboard: thirteen files by declared columns, counted per country without an adapter each."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.clean import norm_name, parse_number, parse_year
from panelweave.sources.files import read_optional_csv


@dataclass(frozen=True)
class Spec:
    """Where one file has its country, year and metric; by_iso: the country is a code."""

    id: str
    label: str
    file: str
    country: str
    year: str
    metric: str | None
    metric_label: str | None
    unit: str | None
    by_iso: bool = True


#: Files and columns of the older dashboard.
SPECS = (
    Spec("aiddata", "AidData", "aiddata_africa_clean.csv", "Country_of_Activity", "Commitment_Year", "Clean_Amount_USD", "项目承诺金额", "USD", by_iso=False),
    Spec("codf", "CODF", "bu_codf_africa_clean.csv", "国家", "年份", "Clean_Amount_USD", "贷款金额", "USD", by_iso=False),
    Spec("cla", "CLA", "cla_africa_clean.csv", "country_en_standard", "Year", "Loan_USD_M", "贷款金额", "USD million", by_iso=False),
    Spec("debt", "Debt relief", "cancellation_africa_clean.csv", "ISO_A3", "Year", "Cancel_Amount_USD_Mn", "债务取消金额", "USD million"),
    Spec("debt", "Debt relief", "restructuring_africa_clean.csv", "ISO_A3", "Year_Numeric", "Restructure_Amount_USD_Mn", "债务重组金额", "USD million"),
    Spec("exports", "Aid exports", "africa_aid_data_clean.csv", "iso3c", "yearmonth", "aid_total", "援助出口价值", "source unit"),
    Spec("fdi", "FDI", "fdi_africa_panel.csv", "ISO_A3", "Year", "Flow_USD", "直接投资流量", "USD"),
    Spec("cofi", "COFI", "cofi_africa_clean.csv", "country_iso3c", "commissioning_year", "total_investment_amount_USD", "总投资额", "USD"),
    Spec("cgef", "CGEF", "CGEF_Africa_2024_Cleaned.csv", "国家", "年份", "贷款金额（百万美元）", "能源贷款金额", "USD million", by_iso=False),
    Spec("cgp", "CGP", "CGP_Africa_2025_Cleaned.csv", "国家", "投产年份", "产能 （兆瓦）", "装机容量", "MW", by_iso=False),
    Spec("chapo", "CHAPO", "chapo_africa_clean.csv", "country_iso", "Commitment_Year", "Amount_USD", "卫生援助金额", "USD"),
    Spec("ihme", "IHME DAH", "ihme_dah_africa_clean.csv", "recipient_isocode", "year", "dah_23_million", "卫生发展援助", "2023 USD million"),
    Spec("china_eu_finance", "China–EU finance", "china_africa_finance_cleaned.csv", "CountryCode", "year", None, None, None),
)
#: Names that resolve to a code beside a country's own.
NAMES = {
    "central african republic": "CAF", "the gambia": "GMB", "gambia": "GMB", "republic of the congo": "COG", "congo republic": "COG", "congo brazzaville": "COG", "congo": "COG", "democratic republic of the congo": "COD", "dr congo": "COD", "drc": "COD",
    "ivory coast": "CIV", "côte d'ivoire": "CIV", "cabo verde": "CPV", "swaziland": "SWZ", "united republic of tanzania": "TZA", "sao tome and principe": "STP", "são tomé and príncipe": "STP", "regional africa": "AFR", "regional, africa": "AFR", "regional": "AFR", "区域性": "AFR",
}


def names_of(metadata: DataFrame) -> DataFrame:
    """(name, code): separator-free names of countries in both languages, other names over them."""
    spark = metadata.sparkSession
    code = F.upper(F.trim("ISO_A3"))
    base = metadata.filter(code != "")
    own = [base.select(norm_name(F.coalesce(F.nullif(F.col(c), F.lit("")), "Country_EN", "ISO_A3")).alias("name"), code.alias("code"), F.lit(1).alias("rank")) for c in ("Country_EN", "Country_CN")]
    others = spark.createDataFrame(sorted(NAMES.items()), "given string, code string").select(norm_name("given").alias("name"), "code", F.lit(2).alias("rank"))
    return reduce(DataFrame.unionByName, [*own, others]).groupBy("name").agg(F.max_by("code", F.struct("rank", "code")).alias("code"))


def spec_rows(raw: DataFrame, spec: Spec, names: DataFrame) -> DataFrame:
    """(source, label, file, place, entity, period, value): rows of one file; entity is NULL where no name or code is given or known."""
    place = F.trim(F.coalesce(F.col(f"`{spec.country}`"), F.lit("")))
    value = parse_number(F.col(f"`{spec.metric}`")) if spec.metric else F.lit(None).cast("double")
    rows = raw.select(F.lit(spec.id).alias("source"), F.lit(spec.label).alias("label"), F.lit(spec.file).alias("file"), place.alias("place"), parse_year(F.col(f"`{spec.year}`")).alias("period"), value.alias("value"))
    if spec.by_iso:
        return rows.withColumn("entity", F.nullif(F.upper("place"), F.lit("")))
    found = rows.withColumn("name", norm_name("place")).join(names, "name", "left")
    return found.withColumnRenamed("code", "entity").drop("name")


def legacy_rows(spark: SparkSession, folder: str, metadata: DataFrame, specs: tuple[Spec, ...] = SPECS) -> DataFrame:
    """Rows of all files, with mapped: whether the entity is a country of the metadata. Absent files have no rows."""
    names = names_of(metadata)
    columns = ["source", "label", "file", "place", "entity", "period", "value"]
    read = lambda s: read_optional_csv(spark, f"{folder}/{s.file}", [c for c in (s.country, s.year, s.metric) if c])
    parts = [spec_rows(read(s), s, names).select(columns) for s in specs]
    known = metadata.select(F.upper(F.trim("ISO_A3")).alias("entity")).filter("entity <> '' and entity <> 'SDN-H'").distinct().withColumn("mapped", F.lit(True))
    return reduce(DataFrame.unionByName, parts).join(known, "entity", "left").withColumn("mapped", F.coalesce("mapped", F.lit(False)))


def legacy_audit(rows: DataFrame) -> DataFrame:
    """Per source: files, rows, mapped rows, known metrics of mapped rows, and their years."""
    mine = lambda c: F.when(F.col("mapped"), F.col(c))
    return rows.groupBy("source", "label").agg(F.countDistinct("file").alias("files"), F.count("*").alias("rows"), F.count_if("mapped").alias("mapped_rows"), F.count(mine("value")).alias("metric_known"), F.min(mine("period")).alias("first"), F.max(mine("period")).alias("last"))


def legacy_unmapped(rows: DataFrame) -> DataFrame:
    """(source, place, n): places given that are no country."""
    return rows.filter("not mapped and place <> ''").groupBy("source", "place").agg(F.count("*").alias("n"))


def legacy_countries(rows: DataFrame) -> DataFrame:
    """(entity, source, records, value, known) of mapped rows; a metric is summed within its source only."""
    return rows.filter("mapped").groupBy("entity", "source").agg(F.count("*").alias("records"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("value"), F.count("value").alias("known"))
