"""Shared parts of the training-data operators.

* ``words``/``word_spans``: the word rule of the whole subpackage,
  ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, on UTF-8 bytes.
* ``cut``: cuts lineage through tables written in ``spark.checkpoint.dir``.
* ``components``: connected components as DataFrame rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import cut

#: Java-regex form of one white-space byte.
SPACE = "[\\x20\\x09-\\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of rows that may be broadcast; beyond it a join is a shuffle. Read at each call, so tests can lower it.
BROADCAST_BYTES = 24 << 20


def is_small(df: DataFrame) -> bool:
    """Whether df's rows, measured whole, are at most BROADCAST_BYTES. df is written already."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    row = F.lit(8 * len(df.columns) + 8).cast("long")
    for w in wide:
        row = row + w
    return (df.agg(F.sum(row)).first()[0] or 0) <= BROADCAST_BYTES


def bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its measured size allows. df is written already, and has no arrays."""
    return F.broadcast(df) if is_small(df) else df


#: A group is hot if it holds more than one in HOT_SHARE of all rows, so at most HOT_SHARE groups are; its rows are dealt to SALTS tasks.
HOT_SHARE, SALTS = 1000, 64


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined to the one row of groups with their key, so that no group of rows fills a task.

    groups is written already and holds each key once, with how many of rows have it in the
    column count. Keys of hot groups are broadcast, HOT_SHARE of them at most; their rows are
    dealt out by a salt, and the rows of groups that they meet are repeated for each salt.
    Keys are not null. rows come from a written table, as the salt is drawn by position.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = groups.where(F.col(count) > max(SALTS, total // HOT_SHARE)).select(F.col(key).alias("_hot"))
    salted = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    salted = salted.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.floor(F.rand(7) * SALTS)).cast("int")).drop("_hot")
    each = F.when(F.col(count) > max(SALTS, total // HOT_SHARE), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(groups.withColumn("_salt", F.explode(each)), [key, "_salt"]).drop("_salt")


def integer_id(table: DataFrame, key: str) -> Column:
    """The id column as long. Ids of other types are refused: number them first."""
    kind = table.schema[key].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"column {key} is of type {kind}; ids must be integers")
    return F.col(key).cast("long")


def unused(name: str, *tables: DataFrame) -> str:
    """name, lengthened until no table has a column of it (Spark ignores case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string column, without a copy where there are no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[0x20, 9, 10, 11, 12, 13]] = False


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text as n + 1 offsets) of all words in a column."""
    inside = _WORD[data]
    at = np.zeros(len(data) + 1, bool)
    at[off] = True  # no word runs on into the next text
    starts = np.flatnonzero(inside & (at[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (at[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, off)


_BYTE = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits (xor-shift, multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("p", ())) < n:
        size = max(n, 1 << 16)
        _TABLES["p"] = _powers(_P, size)
        _TABLES["q"] = _powers(np.uint64(pow(int(_P), -1, 2**64)), size)
    return _TABLES["p"], _TABLES["q"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hash of every word, letters A-Z in lower case: sums of byte values by position, finished by mix()."""
    out = np.empty(len(starts), np.uint64)
    p, q = _tables(block + 1)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + block, side="right")))
        hi = int(ends[j - 1])
        if hi - lo > len(p) - 1:  # one word longer than a block
            p, q = _tables(hi - lo + 1)
        part = _BYTE[LOWER[data[lo:hi]]] * p[: hi - lo]
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((run[e] - run[s]) * q[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 offsets) of each text's distinct k-word shingles, in ascending order.

    A text of fewer words has its whole sequence as one shingle; a text without words none.
    """
    n = len(first) - 1
    counts = np.diff(first)
    m = len(h)
    roll = np.zeros(m, np.uint64)
    for j in range(k):
        roll[: max(0, m - j)] = roll[: max(0, m - j)] * np.uint64(0xD6E8FEB86659FD93) + h[j:]
    roll = mix(roll)
    out, sizes = [], np.zeros(n, np.int64)
    for i in range(n):
        c = int(counts[i])
        if c == 0:
            continue
        a = int(first[i])
        if c < k:
            x = np.uint64(c)
            with np.errstate(over="ignore"):
                for w in h[a : a + c]:
                    x = x * np.uint64(0xD6E8FEB86659FD93) + w
            u = mix(np.array([x], np.uint64))
        else:
            u = np.sort(roll[a : a + c - k + 1])
            if len(u) > 1:
                keep = np.empty(len(u), bool)
                keep[0] = True
                np.not_equal(u[1:], u[:-1], out=keep[1:])
                u = u[keep]
        out.append(u)
        sizes[i] = len(u)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of the links; component is the smallest id reachable.

    Rounds of: each root takes the smallest root among its links, then pointers are
    followed twice. Every round is written, as executors may go.
    """
    links = cut(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    label = cut(links.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        of = label.select(F.col("id"), F.col("component").alias("c"))
        roots = (
            links.join(of.withColumnRenamed("id", "u").withColumnRenamed("c", "cu"), "u")
            .join(of.withColumnRenamed("id", "v").withColumnRenamed("c", "cv"), "v")
            .where("cu <> cv")
            .select(F.greatest("cu", "cv").alias("id"), F.least("cu", "cv").alias("to"))
        )
        hook = cut(roots.groupBy("id").agg(F.min("to").alias("to")))
        if hook.isEmpty():
            return label
        # follow the hooks among roots until they are flat
        flat = hook
        while True:
            up = flat.select(F.col("id").alias("to"), F.col("to").alias("further"))
            flat = cut(flat.join(up, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
            if flat.where("moved").isEmpty():
                break
            flat = flat.drop("moved")
        label = cut(
            label.join(flat.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        )
