"""Operator 5: quality by hierarchical empirical Bayes.

A logistic regression over a text's make-up (shares of byte classes, word lengths, repeats)
gives each document's evidence, the probability that it is good. Sites are hosts and paths
below them. From sums over all documents, grouped by site: the global rate, the rates'
variance between hosts and between the paths of hosts (method of moments), and from them
how many documents a prior counts for. Posterior rates shrink: a host's towards the global
rate, a path's towards its host's; sparse sites stay near their parent. A document's posterior
odds are its evidence's odds times the odds of its path's rate without itself, over the global.

The classifier is fitted on at most ``sample`` labelled rows (parameter, 20,000), drawn by
hash of the id; labels of two classes weigh alike only by their numbers. Labels of documents
held out are never learned from.

Edge cases: null and empty texts have the evidence of an empty text; null hosts and paths are
sites of their own; without labels, or with one class only, all evidence is 0.5 and all is
kept; of several labels of an id the highest counts; a posterior tied with ``least`` is kept;
repeated rows count each; an empty table gives an empty table; very long texts are read whole;
columns of other names play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, documents, utf8, word_hashes, word_spans

_CLASS = np.zeros(256, np.int64)
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b".,;:", b"!?", b"#$%&*", b"|", b"\"'()[]{}<>=_/\\@+-~^`", range(128, 256)), start=1):
    _CLASS[list(_set)] = _k
CLASSES = 12
FEATURES = CLASSES + 7


def features(column: pa.Array) -> np.ndarray:
    """(texts, FEATURES) of whole texts."""
    data, off = utf8(column)
    n = len(off) - 1
    size = np.maximum(1, np.diff(off))
    text = np.repeat(np.arange(n), np.diff(off))
    x = np.zeros((n, FEATURES))
    x[:, :CLASSES] = np.sqrt(np.bincount(text * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES) / size[:, None])
    starts, ends, first = word_spans(data, off)
    words = np.diff(first)
    many = np.maximum(1, words)
    of = np.repeat(np.arange(n), words)
    h = word_hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    x[:, CLASSES] = np.log1p(words)
    x[:, CLASSES + 1] = np.bincount(of, length, n) / many
    x[:, CLASSES + 2] = np.sqrt(np.bincount(of, length**2, n) / many)
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    x[:, CLASSES + 3] = np.bincount(of[order], new, n) / many
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    for j, marks in enumerate((b"#$%&*", b"!?", b"|")):
        x[:, CLASSES + 4 + j] = np.bincount(of, np.isin(last, list(marks)), n) / many
    return x


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray | None:
    """Logistic regression by Newton steps: (mean, scale, weights with the constant last); None for one class."""
    if len(np.unique(y)) < 2:
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.stack([np.append(mean, 0), np.append(scale, 1), w])


def train(labelled: DataFrame, label: str, text: str, key: str, sample: int) -> np.ndarray | None:
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(key)).alias("h"))
    n = max(1, rows.count())
    rows = rows.where(F.col("h").cast("double") + 2.0**63 <= 2.0**64 * min(1.0, 1.2 * sample / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(features(b.column(1))), pa.list_(pa.float64()))], ["y", "h", "x"])

    got = rows.mapInArrow(run, "y double, h long, x array<double>").orderBy("h", "y").limit(sample).collect()
    return fit(np.array([r.x for r in got]), np.array([r.y for r in got]) > 0.5) if got else None


def evidence(docs: DataFrame, model: np.ndarray | None, text: str = "text") -> DataFrame:
    """docs without text, with logit: the log odds that a document is good (0 without a model)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [n for n in docs.columns if n != text]
    rows = docs.select(*names, F.col(text).cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                out = np.zeros(b.num_rows)
                if m is not None:
                    out = np.clip(((features(b.column(len(names))) - m[0, :-1]) / m[1, :-1]) @ m[2, :-1] + m[2, -1], -12, 12)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], [*names, "logit"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return rows.mapInArrow(run, f"{schema}, logit double")


def strength(sites: DataFrame, rate: str, parent: str) -> float:
    """How many documents the parent's rate counts for, from one row (n, rate, parent) per site.

    Method of moments: what the rates vary beyond chance within sites is the variance between them.
    """
    r, q = F.col(rate), F.col(parent)
    row = sites.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("k"), F.sum(F.col("n") * (r - q) * (r - q)).alias("ss"), F.sum(F.col("n") * q * (1 - q)).alias("pq")).first()
    if not row.n or row.k < 2:
        return 1e6
    chance = row.pq / row.n
    between = (row.ss - (row.k - 1) * chance) / max(1e-9, row.n - row.n2 / row.n)
    return float(min(1e6, max(1.0, chance / between - 1))) if between > 0 else 1e6


def posteriors(rows: DataFrame) -> DataFrame:
    """rows(host, path, logit, ...) with host_rate, path_rate, posterior: see the module."""
    p = 1 / (1 + F.exp(-F.col("logit")))
    sums = cut(rows.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("s")))
    total = sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = min(1 - 1e-6, max(1e-6, (total.s + 0.5) / (total.n + 1))) if total.n else 0.5
    hosts = sums.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("rate", F.col("s") / F.col("n")).withColumn("all", F.lit(overall))
    m = strength(hosts, "rate", "all")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + m * overall) / (F.col("n") + m)).alias("host_rate"))
    paths = cut(sums.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h").withColumn("rate", F.col("s") / F.col("n")))
    k = strength(paths, "rate", "host_rate")
    paths = paths.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "host_rate")
    out = rows.join(bounded(paths), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    odds = lambda x: F.log(x / (1 - x))
    clip = lambda x: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))
    out = out.withColumn("path_rate", (F.col("s") + k * F.col("host_rate")) / (F.col("n") + k))
    without = clip((F.col("s") - p + k * F.col("host_rate")) / (F.col("n") - 1 + k))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-(F.col("logit") + odds(without) - odds(F.lit(overall))))))
    return out.select(*rows.columns, "host_rate", "path_rate", "posterior")


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = 20_000, least: float = 0.5, learn: Column | None = None) -> DataFrame:
    """(key, host, path, evidence, host_rate, path_rate, posterior, kept) of every row; learn chooses the labels to learn from."""
    known = labels.where(F.col(key).isNotNull() if learn is None else F.col(key).isNotNull() & learn).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("label"))
    rows = docs.select(F.col(key), host.alias("host"), path.alias("path"), F.col(text))
    model = train(rows.join(known, F.col(key) == F.col("id")), "label", text, key, sample)
    out = posteriors(cut(evidence(rows, model, text)))
    return out.select(key, "host", "path", (1 / (1 + F.exp(-F.col("logit")))).alias("evidence"), "host_rate", "path_rate", "posterior", (F.col("posterior") >= least).alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no sites: hosts are a source's thousands of ids, their paths the languages.

    So there are ever more hosts, of a few dozen documents each, and sparse paths below them.
    Documents whose crc32(doc_id as text) mod 4 is 2 are held out of the fit.
    """
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    host = F.concat(F.coalesce("source", F.lit("none")), F.lit("."), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("none")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return quality(docs, labels, host, F.col("lang"), learn=~held).withColumn("held_out", held)
