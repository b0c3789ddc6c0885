"""Vectors as arrays: validity, similarity, hashed bag-of-words embedding; all in the JVM."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import tokens

DIMENSION = 384


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is referred to."""
    return F.element_at(F.transform(F.array(value), use), 1)


def as_vector(text: Column) -> Column:
    """A vector from JSON text; null when blank, malformed, not numeric or all zero."""
    parsed = F.from_json(text, "array<double>")
    usable = (F.size(parsed) > 0) & F.forall(parsed, lambda x: x.isNotNull()) & F.exists(parsed, lambda x: x != 0)
    return F.when(usable, parsed)


def is_usable(vector: Column, dimension: int | None = None) -> Column:
    """Not empty, of the dimension, finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sized = F.size(vector) == dimension if dimension else F.size(vector) > 0
    return F.coalesce(sized & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for an empty or zero vector or different sizes."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    def scaled(v: Column) -> Column:
        return bound(norm(v), lambda size: F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double"))))

    return bound(a, scaled)


def token_slot(token: Column) -> Column:
    """SHA-256 of the token modulo twice the dimension, from its eight 32-bit words.

    2**32 is 256 modulo 768 and so are its higher powers, so only the sum of the upper words counts.
    """

    def of(digest: Column) -> Column:
        words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]
        upper = words[0]
        for word in words[1:7]:
            upper = upper + word
        return F.pmod(upper * 256 + words[7], F.lit(2 * DIMENSION)).cast("int")

    return bound(F.sha2(token, 256), of)


def hashed_counts(text: Column) -> Column:
    """The signed token counts of a text in DIMENSION slots."""
    slots = F.transform(tokens(text), token_slot)
    signed = F.transform(slots, lambda m: F.struct((m % DIMENSION).alias("at"), F.when(m < DIMENSION, 1.0).otherwise(-1.0).alias("sign")))
    # one pass over the tokens: totals by slot, then the dense vector
    totals = F.aggregate(
        F.array_sort(signed),
        F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("sum"), F.array().cast("array<struct<at:int,total:double>>").alias("made")),
        lambda a, s: F.when(a["at"] == s["at"], F.struct(a["at"].alias("at"), (a["sum"] + s["sign"]).alias("sum"), a["made"].alias("made"))).otherwise(
            F.struct(s["at"].alias("at"), s["sign"].alias("sum"), F.concat(a["made"], F.array(F.struct(a["at"].alias("at"), a["sum"].alias("total")))).alias("made"))
        ),
        lambda a: F.concat(a["made"], F.array(F.struct(a["at"].alias("at"), a["sum"].alias("total")))),
    )
    table = F.map_from_entries(F.filter(totals, lambda t: t["at"] >= 0))
    slots = F.sequence(F.lit(0), F.lit(DIMENSION - 1))
    return bound(table, lambda found: F.transform(slots, lambda i: F.coalesce(F.try_element_at(found, i), F.lit(0.0))))


def counts_of(text: str) -> list[float]:
    """``hashed_counts`` of one text, on the driver, for constants."""
    out = [0.0] * DIMENSION
    for token in re.findall("[a-z0-9]+", text.lower()):
        at = int(hashlib.sha256(token.encode()).hexdigest(), 16) % (2 * DIMENSION)
        out[at % DIMENSION] += 1.0 if at < DIMENSION else -1.0
    return out


def hashed_embedding(text: Column) -> Column:
    """The L2-normalized signed counts; null for a text without tokens whose counts cancel or are missing."""
    return unit(hashed_counts(text))
