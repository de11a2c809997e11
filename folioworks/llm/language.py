"""Operator 8: language identification with a blended-spectrum string kernel.

A text's features are the presence of its n-grams, n = 1..3, of lower-cased letters (all
else is one separator), hashed to 2^15 places. The kernel is the cosine of two presence
vectors. Landmarks drawn from the labelled rows give Nystroem features
``k(x, L) K_LL^(-1/2)``; one-versus-rest kernel ridge regression is solved in them. As the
kernel is linear in the presence vector, landmarks, whitening and coefficients multiply out
to one matrix (places x labels), and batches of texts are scored by one matrix product.

The classifier is fitted on a bounded sample: at most ``per_label`` distinct texts of each
label, drawn by hash of the text (parameter, 400), ``landmarks`` of them (40 per label) as
landmarks. On the driver a label takes 1.6 MB of packed rows and 5 MB of landmarks, and the
equations the square of all landmarks. All rows are scored, as whole texts.

Edge cases: a text that is null or has no letter is ``und`` with score 0; without any
labelled row every row is ``und``; ties go to the label that sorts first; repeated rows
repeat their result; a null label is not learned from; an empty table gives an empty table;
texts of any length are read whole, ``batch`` texts at a time; other columns play no part
and stay as they are, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, cut, documents, unused

PLACES_BITS = 15
PLACES = 1 << PLACES_BITS
_TABLE: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point to its lower-case letter, or 0 for what is no letter."""
    global _TABLE
    if _TABLE is None:
        t = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(sys.maxunicode + 1):
            if (x := chr(c)).isalpha():
                t[c] = ord(low) if len(low := x.lower()) == 1 else c
        _TABLE = t
    return _TABLE


def presence(text: str | None, out: np.ndarray) -> bool:
    """Sets the places of a text's n-grams in out (zeroed bools); False if it has no letter."""
    if not text:
        return False
    x = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not x.any():
        return False
    h = x * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    shift = np.uint32(32 - PLACES_BITS)
    out[(h * np.uint32(0x85EBCA77)) >> shift] = True
    if len(h) > 1:
        two = h[:-1] * np.uint32(0xC2B2AE3D) + h[1:]
        out[(two * np.uint32(0x27D4EB2F)) >> shift] = True
        if len(h) > 2:
            three = two[:-1] * np.uint32(0x165667B1) + h[2:]
            three ^= three >> np.uint32(13)
            out[(three * np.uint32(0x2C1B3C6D)) >> shift] = True
    return True


def fit(bits: np.ndarray, labels: list[str], per_label: int, ridge: float = 1e-3) -> tuple[list[str], np.ndarray]:
    """(labels, matrix places x labels) from presence rows; the first per_label rows of each label are landmarks.

    Rows of PLACES / 8 bytes are packed, a bit a place: the normal equations are sums over blocks of rows, so
    only a block is unpacked at a time, and no feature of all rows is held.
    """
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    marks = np.concatenate([np.flatnonzero(y == k)[:per_label] for k in range(len(names))])
    unit = lambda rows: np.divide(rows, np.sqrt(rows.sum(1, keepdims=True, dtype=np.float32)), out=rows)
    packed = bits.dtype == np.uint8 and bits.shape[1] == PLACES // 8
    wide = lambda rows: (np.unpackbits(rows, axis=1) if packed else rows).astype(np.float32)
    at = unit(wide(bits[marks]))
    k = (at @ at.T).astype(np.float64)
    value, vector = np.linalg.eigh(k)
    keep = value > 1e-6 * value.max()
    white = (vector[:, keep] / np.sqrt(value[keep])) @ vector[:, keep].T
    weight = 1.0 / np.bincount(y, minlength=len(names))  # labels count alike however many rows they have
    left, right = ridge * np.eye(white.shape[1]), np.zeros((white.shape[1], len(names)))
    for i in range(0, len(bits), 128):
        phi = (unit(wide(bits[i : i + 128])) @ at.T).astype(np.float64) @ white
        of = y[i : i + 128]
        weighted = phi * weight[of][:, None]
        left += phi.T @ weighted
        right += weighted.T @ np.where(of[:, None] == np.arange(len(names))[None], 1.0, -1.0)
    coef = np.linalg.solve(left, right)
    coef = white @ coef
    return names, np.concatenate([(at[:, i : i + 1024].T.astype(np.float64) @ coef).astype(np.float32) for i in range(0, at.shape[1], 1024)])


def train(docs: DataFrame, label: str = "lang", text: str = "text", per_label: int = 400, landmarks: int = 40) -> tuple[list[str], np.ndarray]:
    rows = docs.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    # copies count once; a threshold of the hash per label leaves a few times per_label texts; only those are ranked
    distinct = cut(rows.select("label", "h").distinct())
    sizes = distinct.groupBy("label").count()
    top = float(2**63)
    some = distinct.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "label").where(F.col("h").cast("double") + top <= 2 * top * (3.0 * per_label + 30) / F.col("count"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    some = cut(some.withColumn("rank", rank).where(F.col("rank") <= per_label).select("label", "h", "rank"))
    some = rows.join(bounded(some), ["label", "h"]).groupBy("label", "rank").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for t in b.column(2).to_pylist():
                out = np.zeros(PLACES, bool)
                presence(t, out)
                packed.append(np.packbits(out).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["label", "rank", "bits"])

    got = sorted(some.mapInArrow(run, "label string, rank int, bits binary").collect(), key=lambda r: (r.label, r.rank))
    got = [r for r in got if any(r.bits)]
    if not got:
        return [], np.zeros((PLACES, 0), np.float32)
    bits = np.frombuffer(b"".join(r.bits for r in got), np.uint8).reshape(len(got), -1)
    return fit(bits, [r.label for r in got], landmarks)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", sharp: float = 3.0, batch: int = 64, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (softmax of the regressions' outputs, 0 to 1); into renames them."""
    names, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, batch):  # few texts are held as strings at a time
                b = whole.slice(i, batch)
                texts = b.column(at).to_pylist()
                pred, score = ["und"] * len(texts), np.zeros(len(texts))
                if names:
                    seen = np.zeros((len(texts), PLACES), bool)
                    ok = [j for j, t in enumerate(texts) if presence(t, seen[j])]
                    x = seen[ok].astype(np.float32)
                    f = (x @ matrix) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
                    p = np.exp(sharp * (f - f.max(1, keepdims=True)) if len(ok) else f)
                    p /= p.sum(1, keepdims=True)
                    for j, k, v in zip(ok, p.argmax(1), p.max(1)):
                        pred[j], score[j] = names[k], v
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score)], [*b.schema.names, *into])

    schema = T.StructType([*docs.schema.fields, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def keep_identified(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """docs whose language was identified with a score of ``least`` or more; the others go.

    Without any label to learn from, only texts without letters go.
    """
    model = train(docs)
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = unused("pred", docs), unused("score", docs)
    out = predict(docs, model, into=(pred, score))
    return out.where((F.col(pred) != "und") & (F.col(score) >= least)).drop(pred, score)
