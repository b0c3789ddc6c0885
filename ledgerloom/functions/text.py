"""Column functions over page and fact texts."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Patterns that mark a page as a source of facts.  (?U) makes classes Unicode-aware, (?i) ignores case.
NUMBER = r"(?Ui)\b\d[\d,]*\.?\d*\s*(%|percent|bps|basis\s+points)?\b"
CURRENCY = r"(?Ui)[₹$£€¥]|(?:INR|USD|GBP|EUR|JPY|Rs\.?)\s*[\d,]"
PERIOD = (
    r"(?Ui)\bFY\s*'?\d{2,4}\b|\bCY\s*'?\d{2,4}\b|\bQ[1-4]\b|\b(fiscal\s+year|year[-\s]over[-\s]year|YoY|QoQ)\b"
    r"|\b20\d{2}\b|\b\d{1,2}\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+20\d{2}\b"
)
KEYWORDS = (
    r"(?Ui)\b(revenue|profit|loss|margin|ebitda|earnings|growth|decline|income|turnover|sales|expenditure|expense"
    r"|cost|debt|equity|dividend|yield|cagr|roi|roa|roe|eps|pat|pbt|ebit|capex|opex|npa|gnpa|gdp|inflation"
    r"|repo\s+rate|current\s+account|fiscal\s+deficit|forex|reserves|shipment|volume|metric|tonne|kg|km"
    r"|market\s+cap|target\s+price|cmp|current\s+market\s+price|52[-\s]week|shareholding|promoter|promoters"
    r"|institutional|aum|nim|asset|assets|liability|liabilities|borrowing|borrowings|cash\s+flow|valuation"
    r"|stop\s+loss|upside|contraire|financials|balance\s+sheet|p&l|ratio|pe|pb)\b"
)
TABLE = r"(?Ui)(\|.+\|)|(\t.+\t)|(\b(CY|FY)\d{2}.*\b(Revenue|EBITDA|PAT|Sales|EPS)\b)"
SHORTEST_PAGE = 30
NUMBER_IN_ANSWER = r"-?\d[\d,]*(?:\.\d+)?%?"

#: The fields of a fact that lexical retrieval reads, and those that the embedding reads.
LEXICAL_FIELDS = ("entity", "metric", "value", "unit", "period", "scope", "geography", "reporting_basis", "quote")


def stripped(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(stripped(text), F.lit(""))


def clean_page_text(raw: Column) -> Column:
    """Unified line ends, single spaces, stripped lines, one blank line at most in a row; null is ''."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), "\r\n?", "\n")
    text = F.regexp_replace(F.translate(text, "\u00a0", " "), "[ \t]+", " ")
    text = F.regexp_replace(text, r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n")
    return stripped(F.regexp_replace(text, "\n{3,}", "\n\n"))


def is_candidate_page(text: Column) -> Column:
    """Long enough, with a number, and with a currency, a period, a keyword or a table."""
    signal = text.rlike(CURRENCY) | text.rlike(PERIOD) | text.rlike(KEYWORDS) | text.rlike(TABLE)
    return F.coalesce((F.length(stripped(text)) >= SHORTEST_PAGE) & text.rlike(NUMBER) & signal, F.lit(False))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def fact_text(*fields: Column) -> Column:
    """The fields in order, joined by single spaces; a null field is ''."""
    return F.concat_ws(" ", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def embedding_text(*fields: Column) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def numbers(text: Column) -> Column:
    """Distinct numbers in a text, without thousands separators, sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_IN_ANSWER), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")))))


def without_fences(text: Column) -> Column:
    """A JSON answer without a code fence and its language tag."""
    bare = stripped(F.regexp_replace(stripped(text), "^`+|`+$", ""))
    return stripped(F.regexp_replace(bare, "^json", ""))


def _unchanging(least: int) -> str:
    """The larger ranges of characters that compatibility composition leaves as they are beside any other such characters."""
    seconds = {int(parts[1], 16) for c in range(0x10000) if len(parts := unicodedata.decomposition(chr(c)).split()) == 2 and parts[0][0] != "<"}
    joined = {*seconds, *range(0x1100, 0x1200), *range(0xA960, 0xA980), *range(0xAC00, 0xE000)}  # Hangul joins without a table; surrogates
    kept = [c for c in range(0x10000) if c not in joined and not unicodedata.combining(chr(c)) and unicodedata.category(chr(c)) != "Cn" and unicodedata.is_normalized("NFKC", chr(c))]
    starts = [c for c, before in zip(kept, [-2, *kept]) if c != before + 1]
    ends = [c for c, after in zip(kept, [*kept[1:], -2]) if after != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends) if b - a >= least and a > 0)


#: A text without such a character is composed already.  ASCII is told first and ranges are few, because a search tries one after the other; other texts are merely composed for nothing.
CHANGING = f"[[^\\u0000-\\u009f]&&[^{_unchanging(100)}]]"


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    parts = [texts.slice(at, 64) for at in range(0, max(1, len(texts)), 64)]  # few Python strings at once
    return pa.concat_arrays([pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in part.to_pylist()], pa.string()) for part in parts])


def nfkc(text: Column) -> Column:
    """Compatibility composition; Spark has no built-in for it, so texts that it may change go to Python, a few at once."""
    return F.coalesce(_composed(F.when(text.rlike(CHANGING), text)), text)


def match_form(text: Column, composed: bool = True) -> Column:
    """The form in which quotes are searched: NFKC, plain dashes and quotes, single spaces, lower case.

    ``composed=False`` skips NFKC, for texts known to be composed; everything then stays in the JVM.
    """
    text = F.coalesce(text, F.lit(""))
    typed = "\u00a0\u2013\u2014\u2018\u2019\u201c\u201d"
    plain = F.translate(nfkc(text) if composed else text, typed, " --''\"\"")
    return F.lower(stripped(F.regexp_replace(plain, r"(?U)\s+", " ")))
