"""WARC archives: written by Spark, read back by verified record boundaries.

Writing.  A record is text (ASCII headers, then the payload in UTF-8), so Spark's text sink writes
it, with the record trailer CR LF CR LF as its line separator; a file has at most ``PER_FILE``
records and, pages of more than ``LARGE`` bytes being written apart, about ``FILE_BYTES``.  Of records with equal payloads (SHA-1 and length) of at least ``least`` bytes the one
with the smallest page id is the response and the others are revisits that name it.  Every record,
revisits too, carries its whole payload.  Which pages are revisits is known from a pass over ids
and digests; a Bloom filter of fixed size keeps the other pages out of the join that marks them.

Reading.  Files are cut into blocks.  Tasks look for the magic in their blocks and emit candidates:
offset, and the successor's offset that the header's Content-Length implies.  Magic inside a payload
gives candidates too.  Per file, pointer jumping from offset 0 doubles the distance covered in
each round and keeps only what the chain from the file's start reaches; the chain must end at the
file's length, else the archive is damaged and reading fails, as it does where a payload doesn't have
the digest that its header states.  A file's candidates are at most its
bytes over the shortest header.  Digests are taken from the payload's bytes in the block; a payload
that leaves its block's overlap is digested from its file.

Defined cases: a null html is the empty payload; repeated pages give a record each; a null page id
is never a response that others name unless all of its group's ids are null, when all are responses;
line breaks in a url become spaces and a url over 30,000 characters is cut in the header; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bloom import bloom_filter, perhaps_in
from ledgerloom.llm.runtime import arrow_map, importable, materialize, new_path

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
PER_FILE = 2000
LARGE = 256 << 10
FILE_BYTES = 512 << 20
BLOCK = 4 << 20
OVERLAP = 1 << 20
_URN = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 of the SHA-1, from hex digits: five make four base32 digits."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per row of ``pages`` (page_id, url, html) in text files under ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    light = rows.select("page_id", F.octet_length("html").cast("long").alias("n"), base32_sha1(F.col("html")).alias("digest"))
    firsts = light.where(F.col("n") >= least).groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    revisits = light.join(firsts, ["digest", "n"]).where("page_id <> first OR page_id IS NULL AND first IS NOT NULL").select(F.coalesce("page_id", F.lit(-1)).alias("r_id"), F.col("digest").alias("r_digest"), F.col("n").alias("r_n"), "first").distinct()
    named = rows.withColumn("r_key", F.coalesce("page_id", F.lit(-1)))
    importable(pages.sparkSession)
    split = named.withColumn("maybe", perhaps_in(bloom_filter(revisits, "r_id"), "r_key"))
    plain = split.where("NOT maybe").select("page_id", "url", "html", F.lit(None).cast("long").alias("first"), F.lit("response").alias("kind"))
    keyed = split.where("maybe").withColumn("digest", base32_sha1(F.col("html"))).withColumn("n", F.octet_length("html").cast("long"))
    marked = keyed.join(revisits, (keyed.r_key == revisits.r_id) & (keyed.digest == revisits.r_digest) & (keyed.n == revisits.r_n), "left")
    marked = marked.select("page_id", "url", "html", "first", F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("kind"))
    refers = F.when(F.col("first").isNotNull(), F.concat(F.lit(f"WARC-Refers-To: <{_URN}"), F.col("first").cast("string"), F.lit(">\r\n"))).otherwise("")
    record = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "),
        "kind",
        F.lit(f"\r\nWARC-Record-ID: <{_URN}"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.regexp_replace(F.substring("url", 1, 30_000), "[\r\n]", " "),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"),
        base32_sha1(F.col("html")),
        F.lit("\r\n"),
        refers,
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"),
        F.lit("\r\n\r\n"),
        "html",
    )
    records = plain.unionByName(marked)
    longest = rows.agg(F.max(F.octet_length("html") + F.octet_length("url"))).first()[0] or 0
    own = F.octet_length("html") + F.octet_length("url")
    written = [(records, PER_FILE)] if longest <= LARGE else [(records.where(own <= LARGE), PER_FILE), (records.where(own > LARGE), max(1, FILE_BYTES // longest))]
    for part, most in written:
        part.select(record.alias("value")).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", most).text(path)


CANDIDATE = "path string, at long, next long, body long, n long, kind string, page_id long, refers_to long, stated string, digest string"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records of all archives under ``path``; digest is null where the payload leaves its block."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    # outer, so that no filter on the generated array repeats the read of the contents
    blocks = files.where("length > 0").select("path", "length", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(BLOCK).cast("long"))).alias("block"), "content")
    blocks = blocks.select("path", "length", "block", F.expr(f"substring(content, cast(block + 1 AS int), {BLOCK + OVERLAP})").alias("data"))

    def number(text: bytes) -> int | None:
        inner = text.strip().removeprefix(f"<{_URN}".encode()).removesuffix(b">")
        return int(inner) if inner.lstrip(b"-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, length, block, value in zip(*(batch.column(c) for c in ("path", "length", "block", "data"))):
                data, block = value.as_buffer(), block.as_py()
                view = data.to_pybytes()
                at = view.find(MAGIC)
                while 0 <= at < BLOCK:
                    stop = view.find(b"\r\n\r\n", at)
                    fields = dict(line.split(b": ", 1) for line in view[at + len(MAGIC) : stop].split(b"\r\n") if b": " in line) if stop >= 0 else {}
                    size = fields.get(b"Content-Length", b"")
                    if size.isdigit():
                        body, n = stop + 4, int(size)
                        inside = body + n <= len(view)
                        digest = base64.b32encode(hashlib.sha1(view[body : body + n]).digest()).decode() if inside else None
                        stated = fields.get(b"WARC-Payload-Digest", b"").removeprefix(b"sha1:").decode("latin-1")
                        rows.append((name.as_py(), block + at, block + body + n + len(END), block + body, n, fields.get(b"WARC-Type", b"").decode("latin-1"), number(fields.get(b"WARC-Record-ID", b"")), number(fields.get(b"WARC-Refers-To", b"")), stated, digest))
                    at = view.find(MAGIC, at + 1)
            if rows:
                kinds = (pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [p.split()[0] for p in CANDIDATE.split(", ")])

    return arrow_map(blocks, run, CANDIDATE)


def reachable(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which candidates (ascending offsets) the chain from offset 0 reaches."""
    n = len(at)
    if n == 0 or at[0] != 0:
        return np.zeros(n, bool)
    place = np.searchsorted(at, following)
    exact = (place < n) & (at[np.minimum(place, n - 1)] == following)
    jump = np.append(np.where(exact, place, n), n)  # n: no successor
    reached = np.zeros(n + 1, bool)
    reached[0] = True
    for _ in range(int(n).bit_length()):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record on a verified chain."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        return table.filter(pa.array(reachable(table["at"].to_numpy(), table["next"].to_numpy())))

    importable(spark)
    records = materialize(candidates(spark, path).groupBy("path").applyInArrow(chain, CANDIDATE), "records")
    ends = records.groupBy("path").agg(F.max("next").alias("end"))
    damaged = files.select("path", "length").where("length > 0").join(ends, "path", "left").where("end IS NULL OR end <> length").select("path").take(1)
    if damaged:
        raise ValueError(f"damaged archive: {damaged[0].path}")
    long = records.where("digest IS NULL").groupBy("path").agg(F.collect_list(F.struct("at", "body", "n")).alias("parts"))
    if records.where("digest IS NULL").limit(1).count():
        late = files.select("path", "content").join(long, "path").select("path", "content", F.explode_outer("parts").alias("p"))
        late = late.select("path", F.col("p.at").alias("at"), base32_sha1(F.expr("substring(content, cast(p.body + 1 AS int), cast(p.n AS int))")).alias("late"))
        records = records.join(late, ["path", "at"], "left").withColumn("digest", F.coalesce("digest", "late"))
    wrong = records.where("stated <> '' AND stated <> digest").select("path", "at").take(1)
    if wrong:
        raise ValueError(f"payload digest of the record at {wrong[0]['at']} of {wrong[0].path} doesn't match")
    return records.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least)
    return read_archives(spark, path)
