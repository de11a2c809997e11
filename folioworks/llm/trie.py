"""Operator 13: the prefix trie of conversations, rolled up by pointer jumping.

A turn is a digest of role and text; a prefix is the sum of its turns' digests, each taken
with its place, so that running sums give all prefixes of a conversation and long ones
split into blocks whose sums are added up. A node is a distinct prefix, found by grouping; its
parent's digest is an edge. Leaves and saved tokens then climb to all ancestors in doubling
rounds: in round k each node hands what it holds of its subtree to the ancestor 2^k above,
and takes that ancestor's pointer for the next round, so the rounds are the logarithm of the
depth. Nodes less deep than the next step leave, and rows below a very frequent node are
dealt out by a salt.

Texts leave the scan as digests and lengths. Turns are numbered in range partitions, whose
counts give the offsets of conversations that several hold, so that neither a conversation of
any length nor a prefix of any frequency fills one task. The digest of a node's ending
conversations is sequential by definition: their ids are packed into strings by range, and
these stream through one hash, a string at a time.

Edge cases: rows without a conversation id are no conversation and are left out; null roles
and texts are empty; of turns tied (or null) the smaller digest is first, and repeated rows are
turns of their own; conversations without turns after rebuilding are members of the root; an
empty table gives no nodes, not even a root; texts of any length count whole; columns of
other names play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, integer_id, join_groups

#: Base conversations are the multiples of FAMILY; a conversation takes over at most HEADS - 1 of their turns.
FAMILY, HEADS = 100, 6
#: Turns whose sums one window has; characters of ids that one packed string holds.
BLOCK, PACK = 4096, 1 << 16
#: A prefix sum is LIMBS numbers of 32 bits each, summed as longs.
LIMBS = 4
ROOT = hashlib.md5(b"").digest()


def numbered(turns: DataFrame) -> DataFrame:
    """turns (c, turn, h, len; written already) with r, the place of each in its conversation from 1."""
    ranged = cut(turns.repartitionByRange("c", F.col("turn").asc_nulls_first(), "h").withColumn("part", F.spark_partition_id()))
    each = ranged.groupBy("c", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a partition goes on with one conversation at most, so this has a row for each partition at most
    goes_on = each.withColumn("before", before).where("before > 0").select("c", "part", "before")
    local = F.row_number().over(Window.partitionBy("c", "part").orderBy(F.col("turn").asc_nulls_first(), "h"))
    rows = ranged.withColumn("r", local.cast("long")).join(F.broadcast(goes_on), ["c", "part"], "left")
    return rows.select("c", "h", "len", (F.col("r") + F.coalesce("before", F.lit(0))).alias("r"))


def rebuilt(conversations: DataFrame, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """((c, d, h, len, size) of the rebuilt turns with their depth d from 1, (c, size) of all conversations)."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    h = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.select(integer_id(conversations, key).alias("c"), "turn", h.alias("h"), F.char_length(text).cast("long").alias("len"))
    rows = cut(numbered(cut(turns.where("c is not null"))))
    own = rows.groupBy("c").agg(F.count("*").alias("n"))
    own = own.withColumn("heads", F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(HEADS)).cast("int")).withColumn("base", F.col("c") - F.col("c") % FAMILY)
    head = rows.where((F.col("c") % FAMILY == 0) & (F.col("r") < HEADS)).groupBy(F.col("c").alias("base")).agg(F.sort_array(F.collect_list(F.struct("r", "h", "len"))).alias("head"))
    convs = own.join(head, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("heads")))
    convs = convs.withColumn("taken", F.size("head").cast("long"))
    convs = cut(convs.select("c", "n", "heads", "head", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))).alias("size")))
    first = convs.select("c", "size", F.explode("head").alias("t")).select("c", F.col("t.r").alias("d"), "t.h", "t.len", "size")
    later = join_groups(rows, convs.select("c", "n", "heads", "taken", "size"), "c", "n").where("r > heads")
    later = later.select("c", (F.col("r") - F.col("heads") + F.col("taken")).alias("d"), "h", "len", "size")
    return first.unionByName(later), convs.select("c", "size")


def limbs(d: Column, h: Column) -> list[Column]:
    """The digest of a turn at a place, as LIMBS numbers of 32 bits."""
    digits = F.sha2(F.concat(d.cast("string"), F.lit(":"), F.hex(h)), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(LIMBS)]


def prefixes(turns: DataFrame) -> DataFrame:
    """(node, parent, depth, len, c, ends) of each prefix of each conversation but the root; ends says that it is the whole one."""
    names = [f"l{i}" for i in range(LIMBS)]
    blocks = cut(turns.select("c", "d", "len", "size", F.expr(f"(d - 1) div {BLOCK}").alias("block"), *(v.alias(n) for n, v in zip(names, limbs(F.col("d"), F.col("h"))))))
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # only conversations longer than a block have rows here, one for each block
    sums = blocks.where(F.col("size") > BLOCK).groupBy("c", "block").agg(*(F.sum(n).alias(n) for n in names))
    carried = sums.select("c", "block", *(F.sum(n).over(before).alias(f"carried_{n}") for n in names)).where("block > 0")
    run = Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumns({f"run_{n}": F.sum(n).over(run) for n in names}).join(carried, ["c", "block"], "left")
    at = {n: F.col(f"run_{n}") + F.coalesce(f"carried_{n}", F.lit(0)) for n in names}
    name = lambda depth, sums: F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums))))
    node = name(F.col("d"), [at[n] for n in names])
    parent = F.when(F.col("d") == 1, F.lit(ROOT)).otherwise(name(F.col("d") - 1, [at[n] - F.col(n) for n in names]))
    return rows.select(node.alias("node"), parent.alias("parent"), F.col("d").alias("depth"), "len", "c", (F.col("d") == F.col("size")).alias("ends"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end. ends (node, c) is written already."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, length, out = None, [], 0, []

        def close() -> None:
            if ids:
                out.append((node, ids[0], ",".join(map(str, ids))))

        for b in batches:
            for n, c in zip(b["node"].to_pylist(), b["c"].to_pylist()):
                if n != node or length > PACK:
                    close()
                    node, ids, length = n, [], 0
                ids.append(c)
                length += len(str(c)) + 1
            yield from flush(out, 4096)
        close()
        yield from flush(out, 1)

    def flush(out: list[tuple], least: int) -> Iterator[pa.RecordBatch]:
        if len(out) >= least:
            n, c, s = zip(*out)
            yield pa.record_batch({"node": pa.array(n, pa.binary()), "first": pa.array(c, pa.int64()), "ids": pa.array(s)})
            out.clear()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for b in batches:
            for n, s in zip(b["node"], b["ids"]):
                n, s = n.as_py(), s.as_py()
                if n == node:
                    state.update(b"," + s.encode())
                    continue
                if state:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(s.encode())
            yield from whole(done, 4096)
        if state:
            done.append((node, state.hexdigest()))
        yield from whole(done, 1)

    def whole(done: list[tuple], least: int) -> Iterator[pa.RecordBatch]:
        if len(done) >= least:
            n, s = zip(*done)
            yield pa.record_batch({"node": pa.array(n, pa.binary()), "ends_sha256": pa.array(s)})
            done.clear()

    packed = ends.repartitionByRange("node", "c").sortWithinPartitions("node", "c").mapInArrow(pack, "node binary, first long, ids string")
    return packed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(node, columns): sums over all descendants of a node, itself not included. nodes (node, parent, depth, columns) is written already.

    A row of active holds a node's sums over its descendants less than 2^k below, itself
    included, and the ancestor 2^k above. A group of rows with one ancestor has one depth,
    so it leaves as a whole.
    """
    active, given, step = nodes.where("depth > 0").withColumnRenamed("parent", "up"), [], 1
    while True:
        inc = cut(active.groupBy(F.col("up").alias("node")).agg(*(F.sum(c).alias(f"inc_{c}") for c in columns), F.count("*").alias("below")))
        given.append(inc)
        if active.where(F.col("depth") >= 2 * step).isEmpty():
            break
        grown = active.join(inc, "node", "left").select("node", "up", "depth", *((F.col(c) + F.coalesce(f"inc_{c}", F.lit(0))).alias(c) for c in columns), "below")
        grown = cut(grown)
        further = grown.where("below is not null").select(F.col("node").alias("up"), F.col("up").alias("further"), "below")
        far = grown.where(F.col("depth") >= 2 * step).drop("below")
        active = cut(join_groups(far, further, "up", "below").select("node", F.col("further").alias("up"), "depth", *columns))
        step *= 2
    every = given[0]
    for inc in given[1:]:
        every = every.unionByName(inc)
    return every.groupBy("node").agg(*(F.sum(f"inc_{c}").alias(c) for c in columns))


def trie(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node, parent."""
    turns, convs = rebuilt(conversations, key)
    rows = cut(prefixes(turns))
    found = rows.groupBy("node", "parent", "depth", "len").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"))
    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("len"), "conv_id", "n_convs")
    found = cut(found.unionByName(root))
    kids = found.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = found.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("len")).drop("len")
    nodes = cut(nodes)
    below = rolled_up(nodes.select("node", "parent", "depth", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"]).withColumnsRenamed({"n_leaves": "below_leaves", "saved_tokens": "below_saved"})
    ends = rows.where("ends").select("node", "c").unionByName(convs.where("size = 0").select(F.lit(ROOT).alias("node"), "c"))
    out = nodes.join(below, "node", "left").join(ends_digests(cut(ends)), "node", "left")
    # a parent's smallest member, for all its children; the root's stands for a missing one
    names = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = join_groups(nodes.where("parent is not null").select("node", "parent"), names, "parent", "n_children").select("node", "parent_conv_id")
    out = out.join(parents, "node", "left")
    sums = {"n_leaves": F.col("n_leaves") + F.coalesce("below_leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("below_saved", F.lit(0))}
    out = out.withColumns(sums | {"ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))})
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "node", "parent")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node", "parent")


#: CRC-32 of a number's digits: the table of 256 remainders by its rule, then a byte at a time.
_CRC = """crc AS MATERIALIZED (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce([n] || range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS v FROM range(256) AS r(n)))"""
OP13_SQL = f"""
WITH {_CRC},
t AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS r, h, len FROM (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h, length(coalesce(text, '')) AS len FROM conversations WHERE conv_id IS NOT NULL)),
sums AS MATERIALIZED (SELECT c, c - c % {FAMILY} AS base, count(*) AS n, xor(4294967295, list_reduce([4294967295] || [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')], lambda a, b: xor(a >> 8, any_value(crc.t)[(xor(a, b) & 255) + 1]))) % {HEADS} AS heads FROM t, crc GROUP BY c),
convs AS MATERIALIZED (SELECT s.c, s.base, s.heads, least(s.heads, coalesce(b.n, 0)) AS taken FROM sums s LEFT JOIN (SELECT c, n FROM sums) b ON b.c = s.base),
rebuilt AS (SELECT convs.c, t.r AS d, h, len FROM convs JOIN t ON t.c = convs.base AND t.r <= convs.heads
    UNION ALL SELECT convs.c, t.r - heads + taken, h, len FROM convs JOIN t ON t.c = convs.c AND t.r > heads),
pre AS MATERIALIZED (SELECT c, d, md5(string_agg(h, ',') OVER (PARTITION BY c ORDER BY d)) AS node, len, max(d) OVER (PARTITION BY c) AS size FROM rebuilt
    UNION ALL SELECT c, 0, 'root', 0, coalesce((SELECT max(d) FROM rebuilt x WHERE x.c = convs.c), 0) FROM convs),
found AS MATERIALIZED (SELECT p.node, p.d AS depth, min(p.c) AS conv_id, count(*) AS n_convs, any_value(p.len) AS len, any_value(u.node) AS parent,
    sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE p.d = p.size), '')) AS ends_sha256 FROM pre p LEFT JOIN pre u ON u.c = p.c AND u.d = p.d - 1 GROUP BY p.node, p.d),
kids AS (SELECT parent AS node, count(*) AS n_children FROM found GROUP BY parent),
held AS MATERIALIZED (SELECT f.*, coalesce(n_children, 0) AS n_children, (n_children IS NULL)::INT AS leaf, (n_convs - 1) * len AS saved FROM found f LEFT JOIN kids USING (node)),
up AS (SELECT a.node, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM held h JOIN pre a ON a.c = h.conv_id AND a.d <= h.depth GROUP BY a.node)
SELECT h.conv_id, h.depth, p.conv_id AS parent_conv_id, h.n_convs, h.n_children, n_leaves, saved_tokens, h.ends_sha256 FROM held h JOIN up USING (node) LEFT JOIN held p ON p.node = h.parent"""
