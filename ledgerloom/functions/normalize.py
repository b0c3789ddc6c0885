"""Canonical forms of entities, metrics, units, periods, values and geographies, as column functions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import stripped
from ledgerloom.functions.vectors import bound

#: Surface forms and their canonical names.
ENTITY_ALIASES = {
    "m&m": "mahindra & mahindra",
    "m&m ltd": "mahindra & mahindra",
    "mahindra & mahindra ltd": "mahindra & mahindra",
    "mahindra and mahindra": "mahindra & mahindra",
    "bajaj finance ltd": "bajaj finance",
    "bajaj finance limited": "bajaj finance",
}
#: Fixed pattern: what an entity's name may end with.
LEGAL_SUFFIX = r"(?Ui)\b(ltd\.?|limited|corp\.?|corporation|inc\.?|incorporated|co\.?|company|pvt\.?|private)\b"
METRIC_ALIASES = {
    "revenue": "revenue",
    "total revenue": "revenue",
    "revenue from operations": "revenue",
    "net sales": "revenue",
    "sales": "revenue",
    "revenue growth": "revenue_growth",
    "net loss": "net_loss",
    "net profit": "net_profit",
    "profit after tax": "net_profit",
    "pat": "net_profit",
    "pbt": "profit_before_tax",
    "profit before tax": "profit_before_tax",
    "ebitda": "ebitda",
    "ebitda margin": "ebitda_margin",
    "ebit": "ebit",
    "eps": "eps",
    "eps (inr)": "eps",
    "ttm eps": "eps",
    "ttm eps (inr)": "eps",
    "pe ratio": "pe_ratio",
    "pe ratio (ttm)": "pe_ratio",
    "ttm pe": "pe_ratio",
    "p/e": "pe_ratio",
    "p/e (x)": "pe_ratio",
    "roe": "roe",
    "roe (ttm)": "roe",
    "roe (%)": "roe",
    "return on equity": "roe",
    "roa": "roa",
    "return on assets": "roa",
    "div yield": "dividend_yield",
    "dividend yield": "dividend_yield",
    "dividend yield (ttm)": "dividend_yield",
    "cmp": "current_market_price",
    "current market price": "current_market_price",
    "market price": "current_market_price",
    "stock price": "current_market_price",
    "target price": "target_price",
    "target price (rs.)": "target_price",
    "target price (rs)": "target_price",
    "tp": "target_price",
    "12-month target price": "target_price",
    "12m target price": "target_price",
    "upside": "upside",
    "upside potential": "upside",
    "stop loss": "stop_loss",
    "stop loss (closing basis)": "stop_loss",
    "sl": "stop_loss",
    "market cap": "market_cap",
    "market cap (inr mn)": "market_cap_inr",
    "market cap ($ mn)": "market_cap_usd",
    "market cap (usd mn)": "market_cap_usd",
    "market capitalization": "market_cap",
    "mcap": "market_cap",
    "shares o/s": "shares_outstanding",
    "shares o/s (in mn)": "shares_outstanding",
    "shares outstanding": "shares_outstanding",
    "shares outstanding (mn)": "shares_outstanding",
    "avg. volume": "avg_volume",
    "avg. volume (3 month)": "avg_volume_3m",
    "avg volume": "avg_volume",
    "average volume": "avg_volume",
    "52-week high": "52_week_high",
    "52-week high (rs.)": "52_week_high",
    "52-week high (rs)": "52_week_high",
    "52-week range high": "52_week_high",
    "52-week range high (rs.)": "52_week_high",
    "52-week low": "52_week_low",
    "52-week low (rs.)": "52_week_low",
    "52-week low (rs)": "52_week_low",
    "52-week range low": "52_week_low",
    "52-week range low (rs.)": "52_week_low",
    "promoter shareholding": "promoter_shareholding",
    "promoters": "promoter_shareholding",
    "shareholding - promoters": "promoter_shareholding",
    "fii shareholding": "fii_shareholding",
    "fiis": "fii_shareholding",
    "fii": "fii_shareholding",
    "shareholding - fiis": "fii_shareholding",
    "institutional shareholding": "institutional_shareholding",
    "institutions": "institutional_shareholding",
    "shareholding - institutions": "institutional_shareholding",
    "other shareholding": "other_shareholding",
    "others": "other_shareholding",
    "others (incl. body corporate)": "other_shareholding",
    "shareholding - others (incl. body corporate)": "other_shareholding",
    "1-month performance": "performance_1m",
    "1m performance": "performance_1m",
    "6-month performance": "performance_6m",
    "6m performance": "performance_6m",
    "1-year performance": "performance_1y",
    "1yr performance": "performance_1y",
    "aum": "aum",
    "nim": "nim",
    "net interest margin": "nim",
    "gross npa": "gross_npa",
    "gnpa": "gross_npa",
    "npa": "npa",
    "gross npa ratio": "gross_npa_ratio",
    "gdp growth": "gdp_growth",
    "gdp growth rate": "gdp_growth",
    "real gdp growth": "gdp_growth",
    "inflation": "inflation_rate",
    "inflation rate": "inflation_rate",
    "cpi inflation": "inflation_rate",
    "repo rate": "repo_rate",
    "current account deficit": "current_account_deficit",
    "fiscal deficit": "fiscal_deficit",
    "foreign exchange reserves": "forex_reserves",
    "forex reserves": "forex_reserves",
}
UNIT_ALIASES = {
    "%": "percent",
    "percent": "percent",
    "percentage": "percent",
    "pct": "percent",
    "inr": "inr",
    "rs": "inr",
    "rs.": "inr",
    "rupees": "inr",
    "inr crore": "inr_crore",
    "rs. crore": "inr_crore",
    "rs crore": "inr_crore",
    "crore": "inr_crore",
    "crores": "inr_crore",
    "inr lakh": "inr_lakh",
    "lakh": "inr_lakh",
    "inr mn": "inr_million",
    "inr million": "inr_million",
    "rs mn": "inr_million",
    "rs. mn": "inr_million",
    "rs million": "inr_million",
    "inr billion": "inr_billion",
    "rs.764bn": "inr_billion",
    "usd": "usd",
    "$": "usd",
    "us$": "usd",
    "usd mn": "usd_million",
    "$ mn": "usd_million",
    "usd million": "usd_million",
    "usd billion": "usd_billion",
    "bps": "basis_points",
    "basis points": "basis_points",
    "days": "days",
    "x": "multiple",
    "times": "multiple",
}
GEOGRAPHY_ALIASES = {
    "india": "india",
    "indian": "india",
    "in": "india",
    "us": "united_states",
    "usa": "united_states",
    "u.s.": "united_states",
    "united states": "united_states",
    "global": "global",
    "worldwide": "global",
    "domestic": "domestic",
    "international": "international",
}
#: Fixed patterns of periods and values.
FISCAL_YEAR = r"(?Ui)fy\s*'?(\d{2,4})"
YEAR = r"(?U)\b((?:19|20)\d{2})\b"
QUARTER = r"(?Ui)\bq([1-4])\b"
VALUE = r"(?U)-?[\d,]+\.?\d*"


def _looked_up(aliases: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in itertools.chain(*aliases.items())])
    return F.try_element_at(table, key)


def slug(text: Column) -> Column:
    """Lower-case words joined by underscores; may be ''."""
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clean_entity(entity: Column) -> Column:
    """Lower case, without punctuation and legal suffixes, aliases resolved; null is ''."""
    plain = F.regexp_replace(F.lower(stripped(F.coalesce(entity, F.lit("")))), "[,.]+", " ")
    plain = stripped(F.regexp_replace(plain, r"(?U)\s+", " "))

    def resolved(bare: Column) -> Column:
        short = stripped(F.regexp_replace(F.regexp_replace(bare, LEGAL_SUFFIX, ""), r"(?U)\s+", " "))
        return bound(short, lambda s: F.coalesce(_looked_up(ENTITY_ALIASES, bare), _looked_up(ENTITY_ALIASES, s), F.nullif(s, F.lit("")), bare))

    return bound(plain, resolved)


def canonical_metric(metric: Column) -> Column:
    return F.coalesce(_looked_up(METRIC_ALIASES, F.lower(stripped(metric))), slug(metric))


def canonical_unit(unit: Column) -> Column:
    known = F.coalesce(_looked_up(UNIT_ALIASES, F.lower(stripped(unit))), slug(unit))
    return F.when(unit.isNull() | (unit == ""), F.lit("unitless")).otherwise(known)


def canonical_period(period: Column) -> Column:
    """[Qn ]FYyyyy, else the first year alone, else the trimmed text; null and '' are null."""
    text = stripped(period)
    fiscal, year, quarter = (F.regexp_extract(text, p, 1) for p in (FISCAL_YEAR, YEAR, QUARTER))
    full = F.concat(
        F.when(quarter != "", F.concat(F.lit("Q"), quarter, F.lit(" "))).otherwise(F.lit("")),
        F.lit("FY"),
        F.when(F.length(fiscal) == 2, F.concat(F.lit("20"), fiscal)).otherwise(fiscal),
    )
    return F.when((period != "") & (fiscal != ""), full).when((period != "") & (year != ""), year).when(period != "", text)


def numeric_value(value: Column) -> Column:
    """The first number of the text without thousands separators, or null."""
    return F.regexp_extract(F.replace(value, F.lit(","), F.lit("")), VALUE, 0).try_cast("double")


def canonical_geography(geography: Column) -> Column:
    known = F.coalesce(_looked_up(GEOGRAPHY_ALIASES, F.lower(stripped(geography))), slug(geography))
    return F.when(geography.isNotNull() & (geography != ""), known)


def currency_of(unit: Column) -> Column:
    name = canonical_unit(unit)
    return (
        F.when(name.startswith("inr") | (name == "rs"), "INR")
        .when(name.startswith("usd") | (name == "$"), "USD")
        .when(name.startswith("eur"), "EUR")
    )


def normalized(facts: DataFrame) -> DataFrame:
    """``facts`` with the norm_* columns; all are null where the value is not numeric.

    A metric without any letter or digit has no canonical name; its row keeps null norm_* columns.
    """
    value, metric = numeric_value(F.col("value")), canonical_metric(F.col("metric"))
    usable = value.isNotNull() & (metric != "")
    forms = {
        "norm_entity": F.coalesce(F.nullif(clean_entity(F.col("entity")), F.lit("")), stripped(F.col("entity"))),
        "norm_metric": metric,
        "norm_value": value,
        "norm_unit": canonical_unit(F.col("unit")),
        "norm_period": canonical_period(F.col("period")),
        "norm_scope": F.lower(stripped(F.coalesce(F.nullif(F.col("scope"), F.lit("")), F.lit("unspecified")))),
        "norm_geography": canonical_geography(F.col("geography")),
        "norm_currency": currency_of(F.col("unit")),
    }
    return facts.withColumns({name: F.when(usable, form) for name, form in forms.items()})
