"""Secret scans: pattern spans, and spans whose characters pass a battery of randomness tests.

Three patterns give the base spans (assign, access, hex).  Besides, every run of at least
``SHORTEST`` characters of the base64 and URL-safe alphabets is a candidate.  Its encoding (hex,
base32 and base36 of either case, base62, base64) is inferred from its characters and it takes three
tests: chi-squared uniformity of the character counts over that encoding, runs, and lag-1 serial
correlation.  Against a uniform draw, with runs above and below the median character, all three must
be kept at a level of ``KEEP / 3``.  Against ordinary text, with runs of character classes, each
test's value is compared with its mean and deviation over the corpus' own prose of such a length: every
document with gaps and candidates taken out, cut from its first to its last character into stretches of
the bands' lengths in turn.  The three scores are combined into one p-value, weighted by how far the test
tells prose from a uniform draw, and Benjamini and Hochberg's rule controls these within bands of length
over all candidates of the corpus, so that a short string needs stronger evidence where there are many
short strings.  p-values are kept in tenths of a decade, so the table behind the rule has at most bands x
301 rows.

Everything is DataFrame expressions on the row; no text is shuffled.

Defined cases: a null or empty text has no spans; matches of one kind are leftmost and don't
overlap; kinds may overlap each other; a candidate inside a base span is not repeated; equal texts
have equal spans; positions are code points; an empty table gives an empty result; other columns
are kept by ``with_spans`` (a column named ``spans`` is replaced there) and by ``redacted``, whatever their
names, and ignored by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import discard, materialize

#: Fixed patterns of the base kinds, in the order of listing.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

SHORTEST = 20
KEEP = 0.003
FALSE_SHARE = 0.01
BANDS = (24, 32, 48, 80)  # lengths from which the next band starts
PROSE = (22, 28, 40, 64, 96)  # length of the prose that stands for each band
TESTS = ("uniform", "turns", "serial")
DRAWN = {"uniform": 0.0, "turns": 0.55, "serial": 0.0}  # about the values of a uniform draw
FEWEST = 30  # stretches of prose that a band's model needs, else that of all bands holds
MOST_BIN = 300
#: Encodings by their characters, narrowest first; the number of symbols is what uniformity is tested over.
ALPHABETS = (("^[0-9a-fA-F]+$", 16), ("^([A-Z2-7]+|[a-z2-7]+)=*$", 32), ("^([A-Z0-9]+|[a-z0-9]+)$", 36), ("^[A-Za-z0-9]+$", 62))
_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def _spans(text: str, pattern: str, group: int, kind: str, keep: str) -> Column:
    """Spans of the matches of ``pattern`` for which ``keep`` (of x.value) holds; gaps and matches give positions."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    zipped = f"arrays_zip(regexp_extract_all({text}, '{quoted}', 0), regexp_extract_all({text}, '{quoted}', {group}), split({text}, '{quoted}', -1))"
    start = "a.pos + length(x.`2`)"
    value = f"struct({start} AS start, {KINDS.index(kind)} AS rank, {start} + length(x.`0`) AS end, '{kind}' AS kind, x.`1` AS value)"
    return F.expr(
        f"""aggregate({zipped}, struct(0L AS pos, cast(array() AS array<{_SPAN[:-1]},value:string>>) AS found),
        (a, x) -> if(x.`0` IS NULL, a, struct({start} + length(x.`0`) AS pos, if({keep}, concat(a.found, array({value})), a.found) AS found)),
        a -> a.found)"""
    )


def _none() -> Column:
    return F.expr(f"cast(array() AS array<{_SPAN[:-1]},value:string>>)")


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))


def base_spans(text: str) -> Column:
    """Sorted spans of the three patterns in the column named ``text``; cheap searches skip most texts."""
    lower = F.lower(F.col(text))
    named = lower.contains(KEYWORDS[0])
    for word in KEYWORDS[1:]:
        named = named | lower.contains(word)
    assign = F.when(named, _spans(text, ASSIGN, 2, "assign", "length(x.`1`) >= 8")).otherwise(_none())
    access = F.when(F.col(text).contains("AKIA"), _spans(text, ACCESS, 0, "access", "true")).otherwise(_none())
    hexes = F.when(F.col(text).rlike(HEX), _spans(text, HEX, 0, "hex", "true")).otherwise(_none())
    return F.array_sort(_plain(F.concat(assign, access, hexes)))


def _upper_tail(z: str) -> str:
    """P(normal > z) for z >= 0, by a rational approximation with an error below 1e-7."""
    t = f"(1 / (1 + 0.2316419D * ({z})))"
    series = f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    return f"(exp(-0.5D * ({z}) * ({z})) / 2.5066282746310002D * ({series}))"


def _size(value: str) -> str:
    """The number of symbols of the narrowest encoding of ``value``."""
    return "CASE " + " ".join(f"WHEN {value} RLIKE '{pattern}' THEN {size}D" for pattern, size in ALPHABETS) + " ELSE 64D END"


def _scored(candidates: str) -> Column:
    """Candidates as struct(start, rank, end, kind, band, bin, random): the battery on each value."""
    size = _size("s.value")
    codes = "transform(filter(split(s.value, ''), c -> c <> ''), c -> cast(ascii(c) AS double))"
    body = f"""transform(CANDIDATES, s -> struct(s.start AS start, s.rank AS rank, s.end AS end, s.kind AS kind, s.value AS value, {codes} AS codes, {size} AS size))"""
    steps = [
        # sums over characters: squares of counts, median, mean, class changes
        """transform(PREVIOUS, s -> struct(s.start AS start, s.rank AS rank, s.end AS end, s.kind AS kind, s.codes AS codes, s.size AS size, cast(size(s.codes) AS double) AS n,
            aggregate(array_distinct(s.codes), 0D, (t, c) -> t + power(size(filter(s.codes, x -> x = c)), 2)) AS squares,
            element_at(array_sort(s.codes), cast((size(s.codes) + 1) / 2 AS int)) AS middle,
            aggregate(s.codes, 0D, (t, c) -> t + c) / size(s.codes) AS mean,
            transform(s.codes, c -> CASE WHEN c BETWEEN 48 AND 57 THEN 0 WHEN c BETWEEN 65 AND 90 THEN 1 WHEN c BETWEEN 97 AND 122 THEN 2 ELSE 3 END) AS classes))""",
        """transform(PREVIOUS, s -> struct(s.start AS start, s.rank AS rank, s.end AS end, s.kind AS kind, s.n AS n,
            (s.size * s.squares / s.n - s.n - (s.size - 1)) / sqrt(2 * (s.size - 1) * (1 - 1 / s.n)) AS uniform,
            cast(size(filter(s.codes, c -> c > s.middle)) AS double) AS above,
            1 + aggregate(sequence(1, size(s.codes) - 1), 0D, (t, i) -> t + if((get(s.codes, i) > s.middle) <> (get(s.codes, i - 1) > s.middle), 1, 0)) AS runs,
            aggregate(sequence(1, size(s.codes) - 1), 0D, (t, i) -> t + (get(s.codes, i) - s.mean) * (get(s.codes, i - 1) - s.mean)) / greatest(1e-9D, aggregate(s.codes, 0D, (t, c) -> t + (c - s.mean) * (c - s.mean))) AS serial,
            aggregate(sequence(1, size(s.classes) - 1), 0D, (t, i) -> t + if(get(s.classes, i) <> get(s.classes, i - 1), 1, 0)) / (s.n - 1) AS turns))""",
        f"""transform(PREVIOUS, s -> struct(s.start AS start, s.rank AS rank, s.end AS end, s.kind AS kind,
            {' + '.join(f'if(s.n >= {b}, 1, 0)' for b in BANDS)} AS band, s.uniform AS uniform, s.turns AS turns, abs(s.serial) AS serial,
            2 * {_upper_tail("""least(35D, greatest(greatest(0D, s.uniform),
                if(s.above <= 0 OR s.above >= s.n, 99D, abs(s.runs - (1 + 2 * s.above * (s.n - s.above) / s.n)) / sqrt(greatest(1e-9D, 2 * s.above * (s.n - s.above) * (2 * s.above * (s.n - s.above) - s.n) / (s.n * s.n * (s.n - 1))))),
                abs(s.serial + 1 / s.n) * sqrt(s.n)))""")} >= {KEEP / 3}D AS random))""",
    ]
    for step in steps:
        body = step.replace("PREVIOUS", body)
    return F.expr(body.replace("CANDIDATES", candidates))


def marked(texts: DataFrame) -> DataFrame:
    """``texts`` (with a column ``_text`` without nulls) with ``_base`` (sorted spans) and ``_scores`` (the candidates outside them with their tests)."""
    pattern = f"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
    found = F.when(F.col("_text").rlike(pattern), _spans("_text", pattern, 0, "random", "true")).otherwise(_none())
    df = texts.withColumn("_base", base_spans("_text")).withColumn("_runs", found)
    outside = F.filter("_runs", lambda s: ~F.exists("_base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    df = df.withColumn("_candidates", outside)
    return df.withColumn("_scores", _scored("_candidates")).drop("_runs", "_candidates")


def stretches(texts: DataFrame) -> DataFrame:
    """(band, n, value): the texts (column ``_text``) without gaps and candidates, cut whole into stretches of the bands' lengths in turn.

    A text is dealt in rounds of one stretch a band; its last round is longer, so that the stretch which would pass
    the end lies within the round: it ends with the text, and is of the shortest length where the text has no more.
    No stretch is left out but those of texts of fewer characters than the shortest.
    """
    prose = f"regexp_replace(_text, '(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}|[^A-Za-z0-9+/_=-]+', '')"
    rounds = texts.select(F.expr(f"explode(regexp_extract_all({prose}, '.{{{sum(PROSE)}}}(?=.{{{PROSE[-1]}}})|.+', 0))").alias("part"))
    turns = [(sum(PROSE) * again + sum(PROSE[:band]), band) for again in (0, 1) for band in range(len(PROSE))]
    places = "array(" + ", ".join(f"struct({at} AS at, {band} AS band, {PROSE[band]} AS n)" for at, band in turns if at < sum(PROSE) + PROSE[-1]) + ")"
    placed = rounds.select("part", F.expr(f"inline({places})")).where(f"at < length(part) AND length(part) >= {PROSE[0]}")
    placed = placed.select("part", "at", F.expr("if(n <= length(part), band, 0)").alias("band"), F.expr(f"if(n <= length(part), n, {PROSE[0]})").alias("n"))
    return placed.select("band", "n", F.expr("substring(part, least(at, length(part) - n) + 1, n)").alias("value"))


def prose_tests(pieces: DataFrame) -> DataFrame:
    """(band, uniform, turns, serial) of each of the ``stretches``: the tests of ``_scored``, from sums over equal characters and neighbours."""
    runs = r"regexp_extract_all(array_join(sort_array(split(value, '')), ''), '(.)\\1*', 0)"
    codes = "transform(split(value, ''), c -> cast(ascii(c) AS bigint))"
    found = pieces.select("band", "n", "value", F.expr(_size("value")).alias("size"), F.expr(runs).alias("runs"), F.expr(codes).alias("codes"))
    sums = {
        "squares": "aggregate(runs, 0L, (t, r) -> t + length(r) * length(r))",
        "total": "aggregate(runs, 0L, (t, r) -> t + length(r) * ascii(r))",
        "powers": "aggregate(runs, 0L, (t, r) -> t + length(r) * ascii(r) * ascii(r))",
        "products": "aggregate(zip_with(slice(codes, 1, n - 1), slice(codes, 2, n - 1), (a, b) -> a * b), 0L, (t, x) -> t + x)",
        "ends": "get(codes, 0) + get(codes, n - 1)",
        "changes": "size(regexp_extract_all(value, '[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+', 0)) - 1",
    }
    found = found.select("band", "n", "size", *[F.expr(e).alias(name) for name, e in sums.items()])
    return found.select(
        "band",
        F.expr("(size * squares / n - n - (size - 1)) / sqrt(2 * (size - 1) * (1 - 1 / n))").alias("uniform"),
        F.expr("changes / (n - 1)").alias("turns"),
        # whole numbers: n * n times the products of deviations, n times their squares
        F.expr("abs((n * n * products - n * total * (2 * total - ends) + (n - 1) * total * total) / (n * n)) / greatest(1e-9D, (n * powers - total * total) / n)").alias("serial"),
    )


def prose_model(texts: DataFrame) -> dict[int, dict[str, tuple[float, float, float]]]:
    """Mean, deviation and weight of each test in all prose of ``texts`` (column ``_text`` without nulls), for every band."""
    rows = prose_tests(stretches(texts))
    values = [f(F.col(t)).alias(f"{n}_{t}") for t in TESTS for n, f in (("mean", F.avg), ("spread", F.stddev_pop))]
    by_band = {r.band: r for r in rows.rollup("band").agg(F.count(F.lit(1)).alias("n"), *values).collect()}
    model = {}
    for band in range(len(PROSE)):
        row = by_band.get(band)
        row = row if row and row.n >= FEWEST else by_band.get(None)
        if row and row.n >= FEWEST:
            found = {t: (row[f"mean_{t}"], max(row[f"spread_{t}"], 0.02)) for t in TESTS}
        else:  # next to no prose
            found = {"uniform": (8.0, 3.0), "turns": (0.05, 0.05), "serial": (0.1, 0.1)}
        model[band] = {t: (mean, spread, (DRAWN[t] - mean) / spread) for t, (mean, spread) in found.items()}
    return model


def p_bin(model: dict[int, dict[str, tuple[float, float, float]]]) -> str:
    """The p-value of a candidate ``s`` under ordinary text, in tenths of a decade; a test tells nothing past a uniform draw's value."""
    cases = ""
    for band, tests in model.items():
        parts = []
        for t, (mean, spread, weight) in tests.items():
            value = f"(greatest(s.{t}, {DRAWN[t]}D)" if weight < 0 else f"(least(s.{t}, {DRAWN[t]}D)"
            parts.append(f"{weight!r}D * {value} - {mean!r}D) / {spread!r}D")
        norm = sum(w * w for *_, w in tests.values()) ** 0.5 or 1.0
        cases += f" WHEN {band} THEN ({' + '.join(parts)}) / {norm!r}D"
    z = f"least(35D, greatest(0D, CASE s.band{cases} END))"
    return f"cast(least({MOST_BIN}, greatest(0, floor(-10 * log10({_upper_tail(z)})))) AS int)"


def thresholds(scores: DataFrame, model: dict) -> dict[int, int]:
    """The least p-value bin that Benjamini and Hochberg's rule accepts in each length band; ``scores`` has ``_scores``."""
    rows = scores.select(F.explode("_scores").alias("s")).select(F.col("s.band").alias("band"), F.expr(p_bin(model)).alias("bin"))
    counts = rows.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    found: dict[int, int] = {}
    for band in {r.band for r in counts}:
        rows = sorted(((r.bin, r.n) for r in counts if r.band == band), reverse=True)
        total, seen = sum(n for _, n in rows), 0
        for least, n in rows:
            seen += n
            if 10 ** (-least / 10) <= FALSE_SHARE * seen / total:
                found[band] = least
    return found


def found_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_row, _text, _spans): each row as one column, its text and its sorted spans, base ones and accepted random ones."""
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    scores = materialize(marked(texts).select("_scores"), "scores")  # a filter here would repeat the expressions
    model = prose_model(texts)
    least = thresholds(scores, model)
    discard(scores)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    rule = "false" if not least else " OR ".join(f"(s.band = {band} AND {p_bin(model)} >= {bound})" for band, bound in sorted(least.items()))
    random = _plain(F.expr(f"filter(_scores, s -> s.random AND ({rule}))"))
    return marked(rows).select("_row", "_text", F.array_sort(F.concat("_base", random)).alias("_spans"))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (start, rank, end, kind) by start and kind."""
    return found_spans(docs, text).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "spans"], F.col("_spans").alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every document."""
    df = with_spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    counts = [F.size(F.expr(f"filter(spans, s -> s.rank = {rank})")).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    return df.select("doc_id", *counts[:3], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), counts[3])


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; overlapping spans are replaced once."""
    kept = F.expr(
        f"""aggregate(_spans, struct(0L AS pos, '' AS made), (a, s) -> if(s.start >= a.pos,
        struct(s.end AS pos, concat(a.made, substring(_text, cast(a.pos + 1 AS int), cast(s.start - a.pos AS int)), '{mark}') AS made),
        struct(greatest(a.pos, s.end) AS pos, a.made AS made)), a -> concat(a.made, substring(_text, cast(a.pos + 1 AS int), length(_text))))"""
    )
    text = F.when(F.size("_spans") > 0, kept).otherwise(F.col("_row.text"))
    return found_spans(docs).select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
