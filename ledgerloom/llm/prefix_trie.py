"""Prefix trie of conversations, built level by level and rolled up in reverse.

A turn is its 256-bit digest of role and text and its number of words; texts are read once and never
shuffled.  Rebuilt conversations that are equal as a whole become one class first, with its smallest
id and its number of members, so that a group of copies is one row afterwards.

Level by level, the live classes are grouped by (parent node, next turn); a group is a node, named
by its depth and its smallest conv_id.  A class stays live while another class shares its node:
one that is alone has a path of single nodes below it, which are its remaining turns, read in one
pass.  So the number of levels is that of the longest prefix that two different conversations share.
Members of a level's largest nodes (at most ``LARGEST``, those with a share of 1/``LARGEST`` or more)
learn their node by a broadcast of that many rows, all others by a join.

In reverse, each level's nodes are joined with the sums of their children's leaves and savings.

The ids that end at a node are hashed in ascending order: runs of ids become texts of at most
4096 ids in parallel, and a stream in their order hashes them, holding one batch at a time.

Defined cases: null role or text is empty; a null turn sorts first, equal turns by the digest of
role and text; rows without conv_id belong to no conversation and are left out; repeated rows are
separate turns; ``%`` keeps the sign, so that conversations -19 to 19 share base 0; an empty table gives
no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.runtime import arrow_map, discard, materialize, numbered

LARGEST = 1000
NO_IDS = hashlib.sha256(b"").hexdigest()
#: Words are runs of other characters than these.
BLANKS = "\t\n\x0b\f\r"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, key, words): the digest of role and text and the words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.size(F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), ""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), words.cast("long").alias("words"))
    return rows.where("conv_id IS NOT NULL")


def rebuilt(turns: DataFrame, group: int = 20, most_shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, pos, key, words).

    Conversation c starts with the first h turns of c - c % ``group``, h = crc32(decimal c) % ``most_shared``, and goes on with its own after its first h.
    """
    ranked = materialize(numbered(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("key")], "pos").select("conv_id", "pos", "key", "words"), "turns")
    sizes = ranked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared).withColumn("base", F.expr(f"conv_id - conv_id % {group}"))
    bases = sizes.where(f"conv_id % {group} = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = own.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    convs = materialize(convs.select("conv_id", "base", "h", "shared", F.expr("shared + greatest(n - h, 0L)").alias("length")), "conversations")
    later = ranked.join(convs, "conv_id").where("pos > h").select("conv_id", F.expr("shared + pos - h").alias("pos"), "key", "words")
    heads = ranked.where(f"conv_id % {group} = 0 AND pos < {most_shared}").withColumnRenamed("conv_id", "base")
    first = heads.join(convs.where("h > 0"), "base").where("pos <= h").select("conv_id", "pos", "key", "words")
    made = materialize(later.unionByName(first), "rebuilt")
    discard(ranked)
    return convs.select("conv_id", "length"), made


def ids_digest(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rep, m, ends): the smallest id, the number of ids and their digest, of pieces (keys, bucket, first, n, ids) in the order of buckets."""
    names = [*keys, "rep", "m", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []  # [key, first id, number, hash so far]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "first", "n", "ids")]
            for *key, first, n, ids in zip(*columns):
                if now is None or now[0] != key:
                    if now:
                        rows.append((*now[0], now[1], now[2], now[3].digest()))
                    now = [key, first, n, hashlib.sha256(ids.encode())]
                else:
                    now[2] += n
                    now[3].update(b"," + ids.encode())
            if len(rows) > 10_000:
                yield made(rows)
                rows = []
        yield made(rows + ([(*now[0], now[1], now[2], now[3].digest())] if now else []))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * (len(keys) + 2) + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    ordered = pieces.repartition(*keys).sortWithinPartitions(*keys, "bucket")
    return arrow_map(ordered, run, ", ".join(f"{c} long" for c in [*keys, "rep", "m"]) + ", ends binary")


def classes(convs: DataFrame, made: DataFrame) -> DataFrame:
    """(rep, m, length, ends): conversations with equal turns as one row, the smallest id, their number, the digest of their ids."""
    marks = made.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("pos", "key")).alias("x"), F.bit_xor(F.xxhash64("key", "pos")).alias("y"))
    marked = convs.join(marks, "conv_id", "left").select("conv_id", "length", F.coalesce("x", F.lit(0).cast("long")).alias("x"), F.coalesce("y", F.lit(0).cast("long")).alias("y"))
    keys = ["length", "x", "y"]
    pieces = marked.groupBy(*keys, F.expr("shiftright(conv_id, 12)").alias("bucket")).agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.withColumn("ids", F.expr("array_join(transform(ids, i -> cast(i AS string)), ',')"))
    return materialize(ids_digest(pieces, keys).select("rep", "m", "length", "ends"), "classes")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, made = rebuilt(turns_of(conversations))
    reps = classes(convs, made)
    return trie_of(reps, made)


def trie_of(reps: DataFrame, made: DataFrame) -> DataFrame:
    """The nodes over the classes ``reps`` (rep, m, length, ends) and the turns ``made`` (conv_id, pos, key, words)."""
    ends = F.when(F.col("pos") == F.col("length"), F.col("ends"))
    rows = made.join(reps.withColumnRenamed("rep", "conv_id"), "conv_id").select("conv_id", "pos", "key", "words", "m", "length", ends.alias("ends"))
    rows = materialize(rows.repartitionByRange("pos", "conv_id"), "rows")  # a level then reads few files
    whole = reps.agg(F.min("rep"), F.count(F.lit(1)), F.sum("m"), F.max("length"), F.max(F.when(F.col("length") == 0, F.col("ends")))).first()
    root, live, total, longest, turnless = whole
    spark = reps.sparkSession
    top = "conv_id long, parent long, reps long, n long, words long, length long, ends binary"
    first = [(root, None, live, total, 0, longest, turnless)] if live else []
    levels = [spark.createDataFrame([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in first], top)]
    members = reps.select(F.col("rep").alias("conv_id"), F.lit(root).cast("long").alias("parent"))
    while live > 1:
        depth = len(levels)
        step = members.join(rows.where(F.col("pos") == depth), "conv_id")
        groups = step.groupBy("parent", "key").agg(
            F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("reps"), F.sum("m").alias("n"), F.max("words").alias("words"), F.max("length").alias("length"), F.max("ends").alias("ends")
        )
        groups = materialize(groups, "level")
        levels.append(groups.select(F.col("node").alias("conv_id"), "parent", "reps", "n", "words", "length", "ends"))
        shared = groups.where("reps > 1").select("parent", "key", "node", "reps")
        live = shared.agg(F.sum("reps")).first()[0] or 0
        if live:
            slim = step.select("conv_id", "parent", "key")
            large, others = shared.where(f"reps >= {live / LARGEST}").drop("reps"), shared.where(f"reps < {live / LARGEST}").drop("reps")
            own = ["parent", "key"]
            found = slim.join(F.broadcast(large), own).unionByName(slim.join(F.broadcast(large), own, "left_anti").join(others, own))
            before, members = members, materialize(found.select("conv_id", F.col("node").alias("parent")), "members")
            if depth > 1:
                discard(before)
    return rolled_up(levels, rows)


def rolled_up(levels: list[DataFrame], rows: DataFrame) -> DataFrame:
    """The levels' nodes with leaves and savings, from the deepest up, and the single nodes below them."""
    back = Window.partitionBy("conv_id").orderBy(F.col("pos").desc())
    below = rows.where("m > 1").select("conv_id", "pos", F.sum("words").over(back).alias("below"))  # only copies save in single nodes
    below = materialize(below.select("conv_id", "pos", "below"), "below")
    done: list[DataFrame] = []
    alone = None
    for depth in reversed(range(len(levels))):
        nodes = levels[depth]
        own = nodes.where("reps = 1").select("conv_id", F.lit(depth).cast("long").alias("alone_at"))
        alone = own if alone is None else alone.unionByName(own)
        rest = below.where(F.col("pos") == depth + 1).select("conv_id", F.lit(1).cast("long").alias("reps"), "below")
        df = nodes.join(rest, ["conv_id", "reps"], "left")
        if done:
            sums = done[-1].groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("k"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            df = df.join(sums, "conv_id", "left")
        else:
            df = df.withColumns({c: F.lit(None).cast("long") for c in ("k", "leaves", "saved")})
        out = df.select(
            "conv_id",
            F.lit(depth).cast("long").alias("depth"),
            F.col("parent").alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.expr(f"coalesce(k, if(reps = 1 AND length > {depth}, 1L, 0L))").alias("n_children"),
            F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
            F.expr("(n - 1) * (words + if(reps = 1, coalesce(below, 0L), 0L)) + coalesce(saved, 0L)").alias("saved_tokens"),
            F.coalesce(F.lower(F.hex("ends")), F.lit(NO_IDS)).alias("ends_sha256"),
        )
        done.append(materialize(out, "rolled"))
    singles = rows.join(alone, "conv_id").where("pos > alone_at").join(below, ["conv_id", "pos"], "left")
    singles = singles.select(
        "conv_id",
        F.col("pos").alias("depth"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("m").alias("n_convs"),
        F.expr("if(pos < length, 1L, 0L)").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.expr("(m - 1) * coalesce(below, 0L)").alias("saved_tokens"),
        F.coalesce(F.lower(F.hex("ends")), F.lit(NO_IDS)).alias("ends_sha256"),
    )
    for df in done:
        singles = singles.unionByName(df)
    return singles
