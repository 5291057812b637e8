"""Cleaning and labelling of raw cells, as column functions.

Missing stays NULL everywhere; it never becomes zero. Cells beyond ASCII need
NFKD and case folding, which Spark lacks, so these go through pandas UDFs; all
other work stays in the JVM.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- numbers, years, flags -------------------------------------------------

#: What stands for a missing number.
MISSING_NUMBERS = ("", "na", "nan", "none", ".", "tbd")
_NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def parse_number(cell: Column) -> Column:
    """DOUBLE of a cell with thousands separators, NULL if missing, malformed or not finite."""
    text = F.regexp_replace(F.trim(cell.cast("string")), ",", "")
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(~F.lower(text).isin(*MISSING_NUMBERS) & (F.abs(value) < float("inf")), value)


def parse_year(cell: Column) -> Column:
    """The first 19xx or 20xx anywhere in a cell."""
    return F.nullif(F.regexp_extract(cell.cast("string"), r"((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def truthy(cell: Column) -> Column:
    return F.coalesce(F.lower(F.trim(cell.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def first_filled(*cells: Column) -> Column:
    """The first cell that is neither NULL nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cells))


def round_half_even(value: Column, places: int) -> Column:
    """A double rounded to decimal places by its exact binary value, halves to the even digit: 2.675 gives 2.67, 0.125 gives 0.12.

    x times a power of ten is not exact in doubles, but its error is: halves of
    26 bits multiply without one. So the distance to half is known with its
    sign. From 2 ** 53 units of the last place on, doubles are no finer than
    the places and stay.
    """
    scale = float(10**places)
    x = F.abs(value.cast("double"))

    def halves(v: Column) -> tuple[Column, Column]:
        wide = v * float(2**27 + 1)
        high = wide - (wide - v)
        return high, v - high

    (a, b), (c, d) = halves(x), halves(F.lit(scale))
    product = x * scale
    error = ((a * c - product) + a * d + b * c) + b * d
    whole = F.floor(product)
    over = (product - whole.cast("double") - 0.5) + error
    units = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)
    near = F.when(product < float(2**52), units.cast("double") / scale).when(product < float(2**53), product / scale).otherwise(x)
    return F.when(value.cast("double") < 0, -near).otherwise(near)


def amount(value: Column, multiplier: float = 1.0) -> Column:
    return round_half_even(value * multiplier, 6)


def comparable_ratio(left: Column, right: Column, comparable: Column) -> Column:
    """left / right to 6 places where both are known, comparable, and right is not zero."""
    return F.when(comparable & (right != 0), round_half_even(F.try_divide(left, right), 6))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 14 upper-case hex digits of the SHA-1 of the parts; NULL counts as empty."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha1(text.cast("binary")), 1, 14)))


# --- text ------------------------------------------------------------------


def _fold(value: str | None) -> str:
    text = unicodedata.normalize("NFKD", value or "").casefold()
    return text.replace("&", " and ")


@F.pandas_udf(T.StringType())
def _folded(cells: pd.Series) -> pd.Series:
    return cells.map(lambda v: None if v is None else _fold(v))


@F.pandas_udf(T.StringType())
def _folded_ascii(cells: pd.Series) -> pd.Series:
    return cells.map(lambda v: None if v is None else _fold(v).encode("ascii", "ignore").decode())


def _lowered(cell: Column | str, folded) -> Column:
    """A cell in lower case with " and " for &; only cells beyond ASCII pass through Python. NULL is empty."""
    c = F.col(cell) if isinstance(cell, str) else cell
    plain = F.coalesce(c.rlike(r"^[\x00-\x7F]*$"), F.lit(True))
    lower = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "&", " and ")
    return F.when(plain, lower).otherwise(folded(F.when(~plain, c)))


def norm_text(cell: Column | str) -> Column:
    """Folded text with runs of other than a-z, 0-9 and unified ideographs as one space."""
    return F.trim(F.regexp_replace(_lowered(cell, _folded), "[^a-z0-9一-鿿]+", " "))


def norm_name(cell: Column | str) -> Column:
    """As norm_text, without the spaces."""
    return F.regexp_replace(_lowered(cell, _folded), "[^a-z0-9一-鿿]+", "")


def normalized_title(cell: Column | str) -> Column:
    """Folded text in ASCII: what else there is goes without leaving a space."""
    return F.trim(F.regexp_replace(_lowered(cell, _folded_ascii), "[^a-z0-9]+", " "))


#: Words of no weight in titles.
STOPWORDS = ("the", "a", "an", "and", "of", "for", "to", "in", "on", "project", "program", "programme", "china", "chinese", "africa", "government")
#: Words before an identifier that tells sibling projects apart.
MARKERS = ("phase", "lot", "loan", "unit", "package", "section", "stage")
_QUALIFIER = rf"\b({'|'.join(MARKERS)})\s*(\d+|[ivx]+|[a-z])\b"


def title_tokens(normalized: Column) -> Column:
    """Distinct words of three letters or more that are no stopwords."""
    return F.array_except(F.array_distinct(F.filter(F.split(normalized, " "), lambda w: F.length(w) >= 3)), F.array(*map(F.lit, STOPWORDS)))


def title_qualifiers(normalized: Column) -> Column:
    """Sorted marker:identifier strings of a normalised title."""
    of = lambda k: F.regexp_extract_all(normalized, F.lit(_QUALIFIER), F.lit(k))
    return F.array_sort(F.array_distinct(F.zip_with(of(1), of(2), lambda m, i: F.concat_ws(":", m, i))))


def qualifiers_conflict(left: Column, right: Column) -> Column:
    return (F.size(left) > 0) & (F.size(right) > 0) & (left != right)


#: Sectors in order of precedence, with what a normalised sector or title may contain.
SECTORS = (
    ("health", ("120", "health", "medical", "hospital", "clinic", "卫生", "医疗")),
    ("education", ("110", "education", "school", "university", "教育")),
    ("water_sanitation", ("140", "water", "sanitation", "waste", "供水", "卫生设施", "废物")),
    ("transport", ("210", "transport", "rail", "road", "airport", "port", "交通", "铁路", "公路", "港口")),
    ("communications", ("220", "communication", "telecom", "ict", "通信", "信息")),
    ("energy", ("230", "energy", "power", "electric", "hydro", "solar", "coal", "gas", "能源", "电力", "水电")),
    ("finance", ("240", "bank", "financial", "finance", "金融")),
    ("industry_mining", ("250", "320", "industry", "mining", "construction", "工业", "采矿", "建筑")),
    ("agriculture", ("310", "agriculture", "forestry", "fishing", "农业", "林业", "渔业")),
    ("government", ("150", "public administration", "government", "治理", "公共管理")),
    ("environment", ("410", "environment", "climate", "环境", "气候")),
    ("debt", ("600", "debt", "债务")),
    ("humanitarian", ("720", "730", "740", "emergency", "relief", "disaster", "紧急", "救灾")),
    ("multisector", ("430", "multisector", "多部门")),
)
#: Fund types in order of precedence.
FUND_TYPES = (
    ("grant", ("grant", "donation", "technical assistance", "scholarship", "赠款", "捐赠", "援助")),
    ("debt_relief", ("debt forgiveness", "debt cancellation", "免除", "减免")),
    ("equity", ("equity", "fdi", "股权")),
    ("loan", ("loan", "credit", "debt", "贷款", "债权")),
)


def _first_containing(text: Column, rules, default: Column) -> Column:
    found = default
    for label, keywords in reversed(rules):
        hit = F.lit(False)
        for word in keywords:
            hit = hit | text.contains(word)
        found = F.when(hit, F.lit(label)).otherwise(found)
    return found


def harmonize_sector(raw_norm: Column, title_norm: Column, whole_words: bool = False) -> Column:
    """The first sector one of whose keywords the sector or title contains; whole_words wants them between spaces."""
    text = F.concat(F.lit(" "), F.coalesce(raw_norm, F.lit("")), F.lit(" "), F.coalesce(title_norm, F.lit("")), F.lit(" "))
    rules = [(label, tuple(f" {w} " for w in words)) for label, words in SECTORS] if whole_words else SECTORS
    return _first_containing(text, rules, F.when(F.coalesce(raw_norm, F.lit("")) == "", "unspecified").otherwise("other"))


def fund_type(norm: Column, fallback: str = "unspecified") -> Column:
    return _first_containing(F.coalesce(norm, F.lit("")), FUND_TYPES, F.lit(fallback))


# --- labels ----------------------------------------------------------------


def stability_band(delta: Column) -> Column:
    size = F.abs(F.coalesce(delta, F.lit(0.0)))
    return F.when(size <= 0.05, "stable").when(size <= 0.15, "moderate_change").otherwise("sensitive")


def evidence_band(improvement: Column) -> Column:
    return F.when(improvement >= 10, "strong").when(improvement >= 6, "moderate").otherwise("limited")


def lineage(left: Column, right: Column, shared=("codf", "cla", "cgef"), documented=("aiddata", "chapo")) -> Column:
    """How two sources hang together: compiled from one another, cross-referenced, or apart."""
    both = lambda names: left.isin(*names) & right.isin(*names)
    return (
        F.when(both(shared), "likely_shared_lineage")
        .when(both(documented) & (left != right), "documented_cross_reference_overlap")
        .otherwise("distinct_source_comparison")
    )


def compact_number(value: Column) -> Column:
    """1.2T, 3.4B, 5.6M, 7.8K or the rounded number."""
    size = F.abs(value)
    out = F.format_string("%.0f", value.cast("double"))
    for least, mark in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(size >= least, F.format_string("%.1f" + mark, value / least)).otherwise(out)
    return out


def log_share(value: Column, most: Column) -> Column:
    """log10(1 + value) as a share of log10(1 + most), for bars and colours."""
    return F.when(most > 0, F.log10(1 + value) / F.log10(1 + most)).otherwise(0.0)


def project_point(lon: Column, lat: Column, west: float = -20.0, north: float = 38.0, scale: float = 9.15) -> tuple[Column, Column]:
    return (lon - west) * scale, (north - lat) * scale
