"""Line deduplication: content-defined chunks of lines, removed where they repeat.

A text is cut into lines, and a line after sentence ends, so that a passage pasted into a longer
line is seen; the cut keeps every character.  Lines are compared without white space at their end,
and blank ones only go along with the lines around them.

A chunk of lines ends after a line of ``SHORT`` characters, or after a shorter one that equals the
last line or where the rolling hash of its own and the last line's hash is even.  Boundaries so depend on content alone and come
back after an insertion, and chunks are as small as a line can tell; a coarser rule would miss most
passages of a few lines, since none of its chunks lies inside them.  Windows are the fewest
neighbouring chunks, two at least, with twice ``SHORT`` characters together, and single lines of
``LONG`` characters.  A window goes where it occurs earlier by doc_id, text hash and position.  All of a
repeated passage goes but what shares a chunk with its surroundings.  Hashes only propose: lines go
when they equal the first occurrence's byte for byte.  Every removed line so has an equal one
earlier, and the earliest always stays.

Only functions of DataFrames are used.  Rows of windows carry no text.  First occurrences' lines are
exported once for each range of them that a text repeats.  Texts are shuffled
only where a bitmap filter of bounded size says that the document exports or loses lines.

Defined cases: a null text stays null; an empty text stays; rows equal in doc_id and text share one
decision; a null doc_id sorts as -1; a text may become empty; an empty table gives an empty result;
other columns are kept as they are, also ones named like ours; ``counts`` replaces a column named
n_removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bloom import native_split
from ledgerloom.llm.runtime import discard, materialize

SHORT = 20
LONG = 100
_BARE = "trim(TRAILING ' \\t\\r\\n' FROM u)"
_KEY = ["_id", "_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents as one column, and their key."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return df.select("_row", F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(-1)).alias("_id"), F.xxhash64("_row.text").alias("_hash"))


def _units(text: str) -> str:
    """The lines with their ends.  A mark is put after each end and split at, which is faster than looking behind; empty ones may follow."""
    marked = f"replace(replace(replace(replace({text}, '\n', '\n\u0001'), '. ', '. \u0001'), '! ', '! \u0001'), '? ', '? \u0001')"
    behind = rf"split({text}, '(?<=\n)|(?<=[.!?] )', -1)"
    return f"if(contains({text}, '\u0001'), {behind}, split({marked}, '\u0001', -1))"


def _with_lines(df: DataFrame, text: str) -> DataFrame:
    """_units: lines with their ends; _at: numbers of those that aren't blank; _lines: these without white space at the end."""
    df = df.withColumn("_units", F.expr(f"filter({_units(f"coalesce({text}, '')")}, u -> u <> '')"))
    df = df.withColumn("_bare", F.expr(f"transform(_units, u -> {_BARE})"))
    df = df.withColumn("_at", F.expr("if(size(_bare) = 0, cast(array() AS array<int>), filter(sequence(0, size(_bare) - 1), i -> get(_bare, i) <> ''))"))
    return df.withColumn("_lines", F.expr("filter(_bare, u -> u <> '')"))


def _windows(keyed: DataFrame) -> DataFrame:
    """(_id, _hash, start, n, chunk): the windows of each text, in numbers of lines that aren't blank."""
    lines = f"filter(transform({_units("coalesce(_row.text, '')")}, u -> {_BARE}), u -> u <> '')"
    df = keyed.select(*_KEY, F.expr(lines).alias("_lines"))
    df = df.select(*_KEY, F.expr("transform(_lines, u -> length(u))").alias("_n"), F.expr("transform(_lines, u -> xxhash64(u))").alias("_x"))
    every = "if(size(_n) = 0, cast(array() AS array<int>), sequence(0, size(_n) - 1))"
    df = df.withColumn("_ends", F.expr(f"filter({every}, k -> get(_n, k) >= {SHORT} OR k = size(_n) - 1 OR coalesce(get(_x, k - 1), 0L) = get(_x, k) OR ((shiftright(coalesce(get(_x, k - 1), 0L), 1) ^ get(_x, k)) & 1) = 0)"))
    df = df.withColumn("_starts", F.expr("transform(_ends, (e, i) -> if(i = 0, 0, get(_ends, i - 1) + 1))"))
    # slice inside a function over arrays copies the whole array, so it is kept for the rare long cases
    df = df.withColumn("_c", F.expr("transform(_ends, (e, i) -> CASE WHEN e = get(_starts, i) THEN get(_x, e) WHEN e = get(_starts, i) + 1 THEN xxhash64(get(_x, e - 1), get(_x, e), 2) ELSE xxhash64(slice(_x, get(_starts, i) + 1, e - get(_starts, i) + 1), 2) END)"))
    df = df.withColumn("_s", F.expr("transform(_ends, (e, i) -> CASE WHEN e = get(_starts, i) THEN get(_n, e) WHEN e = get(_starts, i) + 1 THEN get(_n, e - 1) + get(_n, e) ELSE aggregate(sequence(get(_starts, i), e), 0, (t, k) -> t + get(_n, k)) END)"))
    pairs = "if(size(_c) < 2, cast(array() AS array<int>), sequence(0, size(_c) - 2))"
    enough = f">= {2 * SHORT} THEN"
    fewest = f"""CASE WHEN get(_s, i) + get(_s, i + 1) {enough} 2 WHEN get(_s, i) + get(_s, i + 1) + get(_s, i + 2) {enough} 3
        WHEN get(_s, i) + get(_s, i + 1) + get(_s, i + 2) + get(_s, i + 3) {enough} 4
        ELSE aggregate(sequence(i, least(i + {2 * SHORT}, size(_s) - 1)), struct(0 AS total, 0 AS count),
        (a, k) -> if(a.total >= {2 * SHORT}, a, struct(a.total + get(_s, k) AS total, a.count + 1 AS count)), a -> if(a.total >= {2 * SHORT}, greatest(a.count, 2), NULL)) END"""
    # outer, since a filter inferred from an inner generator would repeat all of the above
    rows = f"""concat(
        transform(transform({pairs}, i -> struct(i AS i, {fewest} AS c)), w -> struct(get(_starts, w.i) AS start, get(_ends, w.i + w.c - 1) - get(_starts, w.i) + 1 AS n,
            CASE WHEN w.c = 2 THEN xxhash64(get(_c, w.i), get(_c, w.i + 1)) WHEN w.c = 3 THEN xxhash64(get(_c, w.i), get(_c, w.i + 1), get(_c, w.i + 2)) WHEN w.c > 3 THEN xxhash64(slice(_c, w.i + 1, w.c), 3) END AS chunk)),
        transform(filter({every}, k -> get(_n, k) >= {LONG}), k -> struct(k AS start, 1 AS n, xxhash64(get(_x, k), 1) AS chunk)))"""
    return df.select(*_KEY, F.inline_outer(F.expr(rows))).where("chunk IS NOT NULL")


def _stretches(windows: DataFrame) -> DataFrame:
    """(_id, _hash, first_id, first_hash, low, high, parts): the windows of a text that repeat one first text.

    Parts are (start, n, first_start); low to high are the first's lines to export.
    """
    # by longs alone first, which hash aggregation takes; few windows are left for the full order
    repeated = windows.groupBy("chunk").agg(F.count(F.lit(1)).alias("times"), F.min("_id").alias("least")).where("times > 1").select("chunk", "least")
    places = materialize(windows.join(repeated, "chunk"), "places")
    firsts = places.where("_id = least").groupBy("chunk").agg(F.min(F.struct("_hash", "start")).alias("first"))
    firsts = firsts.select("chunk", F.col("first._hash").alias("first_hash"), F.col("first.start").alias("first_start"))
    later = places.join(firsts, "chunk").where("NOT (_id = least AND _hash = first_hash AND start = first_start)")
    found = later.groupBy(*_KEY, F.col("least").alias("first_id"), "first_hash").agg(
        F.min("first_start").alias("low"), F.max(F.expr("first_start + n - 1")).alias("high"), F.collect_set(F.struct("start", "n", "first_start")).alias("parts")
    )
    found = materialize(found, "stretches")
    discard(places)
    return found


def deduplicated(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``; ``counts`` adds n_removed."""
    keyed = _keyed(docs)
    windows = materialize(_windows(keyed), "windows")
    stretches = _stretches(windows)
    discard(windows)
    first = ["first_id", "first_hash"]
    wanted = stretches.groupBy(*first).agg(F.collect_set(F.struct("low", "high")).alias("_wanted"))
    sources, _ = native_split(keyed.withColumnsRenamed({"_id": "first_id", "_hash": "first_hash"}), wanted, first)
    exported = _with_lines(sources.select(*first, F.col("_row.text").alias("_text")).dropDuplicates(first).join(wanted, first), "_text")
    exported = exported.select(*first, F.inline_outer(F.expr("transform(_wanted, w -> struct(w.low AS low, w.high AS high, transform(sequence(w.low, w.high), i -> get(_lines, i)) AS same))")))
    later = stretches.join(exported, [*first, "low", "high"])
    lists = materialize(later.groupBy(*_KEY).agg(F.collect_list(F.struct("low", "same", "parts")).alias("_later")), "later")
    discard(stretches)
    losing, rest = native_split(keyed, lists, _KEY)
    df = _with_lines(losing.join(lists, _KEY, "left"), "_row.text")
    equal = "filter(x.parts, p -> forall(sequence(0, p.n - 1), i -> get(_lines, p.start + i) = get(x.same, p.first_start - x.low + i)))"
    df = df.withColumn("_gone", F.expr(f"array_distinct(flatten(transform(_later, x -> flatten(transform({equal}, p -> sequence(get(_at, p.start), get(_at, p.start + p.n - 1)))))))"))
    df = df.withColumn("_kept", F.expr("if(coalesce(size(_gone), 0) <= 0, NULL, array_except(sequence(0, size(_units) - 1), _gone))"))
    text = F.expr("if(_kept IS NULL, _row.text, array_join(transform(_kept, i -> get(_units, i)), ''))")
    removed = F.expr("if(coalesce(size(_gone), 0) <= 0, 0L, cast(size(_gone) AS bigint))")

    def columns(text: F.Column, removed: F.Column) -> list:
        return [text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if not (counts and c == "n_removed")] + ([removed.alias("n_removed")] if counts else [])

    return df.select(*columns(text, removed)).unionByName(rest.select(*columns(F.col("_row.text"), F.lit(0).cast("long"))))
