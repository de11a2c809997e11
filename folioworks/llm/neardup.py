"""Operator 9: near-duplicates by MinHash and a multi-index Hamming join.

1. Every document's distinct word shingles give a signature of ``chunks * width`` MinHash
   values of 8 bits. The signature distance is the number of differing values.
2. Documents with equal sets are one class; its smallest id stands for it from here on.
3. Multi-index: signatures are cut into chunks. Two signatures within ``distance`` have, by
   pigeonhole, a chunk with at most ``errors = distance // chunks`` differing values; all
   ways to leave out that many values of a chunk are enumerated as keys, so every pair
   within the distance shares a key.
4. Per key, all are compared with the key's smallest id. Keys whose members are then not
   connected are compared further: few members by a join, many in blocks whose kernel keeps
   a spanning forest only. So whatever is within the distance becomes connected, and no
   pairs of a group are emitted.
5. Each group so connected is verified on full shingle sets, recomputed for its members
   only, in blocks of bounded size; the kernel keeps a spanning forest of the exact links.
6. Connected components of the exact links.

``distance`` is chosen so that a pair at the similarity threshold exceeds it with a
probability of at most 1.5e-5 (exact binomial tail; ``miss``, parameter); pairs above the
threshold less often.

Edge cases: null and empty texts have no shingles and no links; fewer words than k are one
shingle; repeated rows and rows that share an id are one node and get one component; rows
with a null id are never linked (component null, kept); ties go to the smallest id; texts of
any length are read as a whole; empty tables give empty tables; other columns are ignored,
whatever their names; ids that are no integers are refused with a TypeError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, components, cut, documents, integer_id, mix, shingles, unused, utf8, word_hashes, word_spans

#: Members of a key that a join compares; more go to blocks of BLOCK, of which every pair is a group.
#: A member's row (a signature) is repeated once for each block of its key, so blocks are large.
FEW, BLOCK = 32, 4096
#: Shingles and members of a block in the verification.
BLOCK_SHINGLES, BLOCK_MEMBERS = 1_000_000, 4096

def beyond(n: int, p: float, most: int) -> float:
    """The probability that more than ``most`` of n values differ, each with probability p."""
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(most + 1, n + 1))


@dataclass(frozen=True)
class Scheme:
    k: int
    percent: int
    chunks: int
    width: int
    distance: int

    @property
    def errors(self) -> int:
        return self.distance // self.chunks

    @staticmethod
    def of(k: int, percent: int, width: int, errors: int = 1, miss: float = 1.5e-5) -> Scheme:
        """The fewest chunks for which the distance that holds pairs at the threshold is covered."""
        differ = (1 - percent / 100) * 255 / 256
        for chunks in range(1, 200):
            n = chunks * width
            distance = next(d for d in range(n + 1) if beyond(n, differ, d) <= miss)
            if chunks * (errors + 1) > distance:
                return Scheme(k, percent, chunks, width, distance)
        raise ValueError("no number of chunks holds the distance")


CONTRACT = Scheme.of(3, 85, 6)
FIVE_WORDS = Scheme.of(5, 80, 5)


def minhash(h: np.ndarray, off: np.ndarray, size: int) -> np.ndarray:
    """(texts, size) bytes; h are the distinct shingles of all texts, none of which is empty."""
    rnd = np.random.RandomState(7)
    seeds = rnd.randint(0, 2**63 - 1, size, dtype=np.int64).astype(np.uint64)
    odds = rnd.randint(0, 2**62 - 1, size, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(off) - 1
    least = np.empty((size, n), np.uint64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + 16384, side="right")) - 1)
        part, at = h[off[i] : off[j]], off[i:j] - off[i]
        for s in range(size):
            least[s, i:j] = np.minimum.reduceat((part ^ seeds[s]) * odds[s], at)
        i = j
    return np.ascontiguousarray((mix(least) & np.uint64(255)).astype(np.uint8).T)


def keys_of(sig: np.ndarray, scheme: Scheme) -> np.ndarray:
    """(texts, keys): for each chunk, its values with every choice of ``errors`` of them left out."""
    out = []
    for c in range(scheme.chunks):
        part = sig[:, c * scheme.width : (c + 1) * scheme.width].astype(np.uint64)
        for gone in combinations(range(scheme.width), scheme.errors):
            key = np.full(len(sig), c * 4096 + sum(1 << g for g in gone) + 1, np.uint64)
            for p in range(scheme.width):
                if p not in gone:
                    key = key * np.uint64(0x100000001B3) + part[:, p] + np.uint64(1)
            out.append(mix(key))
    return np.stack(out, axis=1).view(np.int64)


def sets_of(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8(column)
    starts, ends, first = word_spans(data, off)
    return shingles(word_hashes(data, starts, ends), first, k)


def signatures(docs: DataFrame, scheme: Scheme, key: str, text: str) -> DataFrame:
    """(id, n, f1, f2, sig, keys) of every row; f1 and f2 are sums over the set, equal for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                b = batch.slice(i, 1024)
                h, off = sets_of(b.column(1), scheme.k)
                n = np.diff(off)
                full = np.flatnonzero(n)
                f = np.zeros((2, len(n)), np.int64)
                sig: list[bytes | None] = [None] * len(n)
                keys: list[np.ndarray | None] = [None] * len(n)
                if len(full):
                    starts = off[full]
                    f[0, full] = np.add.reduceat(mix(h), starts).view(np.int64)
                    f[1, full] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts).view(np.int64)
                    s = minhash(h, np.append(starts, len(h)), scheme.chunks * scheme.width)
                    for j, row, own in zip(full, s, keys_of(s, scheme)):
                        sig[j], keys[j] = row.tobytes(), own
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n), pa.array(f[0]), pa.array(f[1]), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "n", "f1", "f2", "sig", "keys"],
                )

    rows = docs.select(integer_id(docs, key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n long, f1 long, f2 long, sig binary, keys array<long>")


def within(pairs: DataFrame, sigs: DataFrame, distance: int) -> DataFrame:
    """The (a, b) whose signatures differ in at most ``distance`` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in (2, 3))
                yield b.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= distance))

    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Joins i with others; returns one of others for each part that was new."""
        labels, at = np.unique(self.label[others], return_index=True)
        new = labels != self.label[i]
        if new.any():
            self.label[np.isin(self.label, labels[new])] = self.label[i]
        return others[at[new]]


def forest_by_signature(distance: int):
    """Kernel of a block pair: spanning forest of what is within the distance and not yet connected."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sig = pdf["id"].to_numpy(), np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
        forest = Forest(len(ids))
        forest.label = np.unique(pdf["c"].to_numpy(), return_inverse=True)[1]
        out: list[tuple[int, int]] = []
        for i in range(len(ids)):
            rest = np.flatnonzero(forest.label != forest.label[i])
            if not len(rest):
                break
            near = rest[(sig[rest] != sig[i]).sum(1) <= distance]
            out += [(ids[i], ids[j]) for j in forest.join(i, near)] if len(near) else []
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def block_pairs(df: DataFrame, blocks: str) -> DataFrame:
    """df with (p, q): every row of block p or q, for all p <= q < blocks; the block is a hash of the id."""
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.col(blocks)).cast("int")
    with_own = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    return with_own.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))


def signature_groups(sigs: DataFrame, scheme: Scheme) -> DataFrame:
    """(id, component): connected groups of classes within the signature distance."""
    rows = sigs.select("id", F.explode("keys").alias("key"))
    firsts = rows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("members")).where("first < last")
    members = cut(rows.join(firsts.drop("last"), "key"))
    stars = cut(within(members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), sigs, scheme.distance))
    label = components(stars)
    known = members.join(label, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    open_keys = known.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    rest = cut(known.join(open_keys, "key").select("key", "id", "c", "members"))
    few = rest.where(F.col("members") <= FEW)
    left, right = few.select("key", F.col("id").alias("a"), F.col("c").alias("ca")), few.select("key", F.col("id").alias("b"), F.col("c").alias("cb"))
    pairs = left.join(right, "key").where("a < b and ca <> cb").select("a", "b").distinct()
    more = within(pairs, sigs, scheme.distance)
    many = rest.where(F.col("members") > FEW).withColumn("blocks", F.ceil(F.col("members") / BLOCK))
    many = block_pairs(many, "blocks").join(sigs.select("id", "sig"), "id")
    more = more.unionByName(many.groupBy("key", "p", "q").applyInPandas(forest_by_signature(scheme.distance), "a long, b long"))
    return components(stars.unionByName(cut(more.distinct())))


def exact_forest(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among sets, as pairs of positions.

    With side given, only pairs of different sides count: the others are another task's.
    """
    n = np.array([len(s) for s in sets])
    off = np.concatenate(([0], np.cumsum(n)))
    value = np.unique(np.concatenate(sets), return_inverse=True)[1]
    flag = np.zeros(value.max() + 1 if len(value) else 0, np.int32)
    forest, out = Forest(len(sets)), []
    for i in range(len(sets)):
        differ = forest.label != forest.label[i]
        if side is not None:
            differ &= side != side[i]
        else:
            differ[:i] &= False  # compared when it was their turn
        rest = np.flatnonzero(differ & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        if not len(rest):
            continue
        own = value[off[i] : off[i + 1]]
        flag[own] = 1
        at = np.concatenate([value[off[j] : off[j + 1]] for j in rest])
        common = np.add.reduceat(flag[at], np.concatenate(([0], np.cumsum(n[rest])[:-1])))
        flag[own] = 0
        linked = rest[100 * common >= percent * (n[i] + n[rest] - common)]
        if len(linked):
            out += [(i, int(j)) for j in forest.join(i, linked)]
    return out


def links(docs: DataFrame, sigs: DataFrame, groups: DataFrame, scheme: Scheme, key: str, text: str) -> DataFrame:
    """(a, b): a spanning forest of the exact links within the groups."""
    sized = groups.join(sigs.select("id", "n"), "id")
    of = sized.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_MEMBERS)).alias("blocks"))
    wanted = cut(groups.join(of, "component").select(F.col("id").alias("want"), F.col("component").alias("g"), "blocks").distinct())
    rows = docs.select(integer_id(docs, key).alias("id"), F.col(text).cast("string").alias("text"))
    chosen = rows.join(bounded(wanted), F.col("id") == F.col("want")).select("id", "g", "blocks", "text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                h, off = sets_of(b.column(3), scheme.k)
                packed = [h[off[j] : off[j + 1]].tobytes() for j in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(packed, pa.binary())], ["id", "g", "blocks", "set"])

    def kernel(ids: list[int], sets: list[bytes], own: list[int], p: int, q: int) -> Iterator[tuple[int, int]]:
        arrays = [np.frombuffer(s, np.uint64) for s in sets]
        for i, j in exact_forest(arrays, np.array(own) if p != q else None, scheme.percent):
            yield ids[i], ids[j]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (g, p, q), so a group's rows follow each other."""
        at, ids, sets, own, out = None, [], [], [], []
        done = lambda: pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
        for b in batches:
            for g, p, q, i, o, s in zip(*(c.to_pylist() for c in b.columns)):
                if (g, p, q) != at:
                    if len(ids) > 1:
                        out += kernel(ids, sets, own, at[1], at[2])
                    at, ids, sets, own = (g, p, q), [], [], []
                ids.append(i), sets.append(s), own.append(o)
            yield done()
            out = []
        if len(ids) > 1:
            out += kernel(ids, sets, own, at[1], at[2])
        yield done()

    sets = block_pairs(chosen.mapInArrow(compute, "id long, g long, blocks long, set binary"), "blocks")
    sets = sets.select("g", "p", "q", "id", "own", "set").repartition("g", "p", "q").sortWithinPartitions("g", "p", "q")
    return sets.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, scheme: Scheme = CONTRACT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row."""
    rows = cut(signatures(docs, scheme, key, text))
    full = rows.where("n > 0 and id is not null")
    classes = full.groupBy("n", "f1", "f2").agg(F.min("id").alias("first"))
    member = full.select("id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"]).select("id", "first")
    copies = cut(member.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    sigs = cut(full.join(classes.select(F.col("n").alias("cn"), F.col("f1").alias("c1"), F.col("f2").alias("c2"), "first"), (F.col("n") == F.col("cn")) & (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")) & (F.col("id") == F.col("first"))).select("id", "n", "f1", "f2", "sig", "keys").dropDuplicates(["id", "n", "f1", "f2"]))
    groups = signature_groups(sigs, scheme)
    exact = cut(links(docs, sigs, groups, scheme, key, text))
    label = components(exact.unionByName(copies))
    out = rows.select("id", F.col("n").alias("n_shingles")).join(label.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def drop_near_duplicates(docs: DataFrame, scheme: Scheme = FIVE_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that a smaller id stands for; of rows with one id and text one stays.

    Ids to go, and ids that several rows share, are few against the texts: they are broadcast
    if their measured size allows, so that texts stay where they are.
    """
    found = cut(near_duplicates(docs, scheme, key, text).select(F.col(key).alias("id"), "kept"))
    gone, many, row = unused("gone", docs), unused("many", docs), unused("row", docs)
    ids = bounded(cut(found.where("not kept").select(F.col("id").alias(gone)).distinct()))
    left = docs.join(ids, F.col(key) == F.col(gone), "left_anti")
    twice = cut(found.where("kept and id is not null").groupBy(F.col("id").alias(many)).count().where("count > 1").select(many))
    if twice.isEmpty():
        return left
    twice = bounded(twice)
    repeated = left.join(twice, F.col(key) == F.col(many), "left_semi")
    first = Window.partitionBy(key, F.xxhash64(text)).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    repeated = repeated.withColumn(row, F.row_number().over(first)).where(F.col(row) == 1).drop(row)
    return left.join(twice, F.col(key) == F.col(many), "left_anti").unionByName(repeated)


OP9_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM t),
n AS (SELECT doc_id, len(s) AS n FROM sets),
g AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other),
part AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN part USING (doc_id)
"""
