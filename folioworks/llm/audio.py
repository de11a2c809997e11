"""Operator 6: chroma audio fingerprints.

A recording becomes frames of 12 pitch classes. Filters (rectangles of ones against
rectangles of minus ones over frames and classes) are read off an integral image; each
gives two bits by its three thresholds in Gray code, 16 filters a packed integer of 32 bits.
Two recordings are aligned at an offset if they overlap in ``min_overlap`` integers or more
and the share of differing bits is at most ``max_error``, and besides so small that unrelated
recordings do not reach it by chance: at least ``z`` standard deviations below what these
have (``UNRELATED``; the deviation falls with the root of the overlap).

Equal fingerprints are one class. The search (``alignments``, the registered query) takes a
stated set of recordings as queries against all. Multi-index: every position of a recording
gives six keys, its integer and the one ``REACH`` further without two of their four bytes, so
that errors within two bytes do not hide it and 32 bits remain to tell recordings apart.
Queries with frequent keys in common are packs; a pack and the recordings that share keys with
it meet in a task, where hits of a pair at each offset are its histogram, so that neither hits
nor pairs of a large group of near copies are rows. Offsets with ``min_votes`` or more are
tested for bit errors, and of those that pass the one with the most votes is the pair's
alignment. A position that repeats the one before has no keys of its own, so silence and
sustained tones do not multiply hits. The index is approximate; the README has its recall
against all pairs at all offsets.

``recordings_aligned`` groups recordings into components: with ``every`` it tests all pairs
at all offsets in pairs of blocks (exact, quadratic), without it pairs with an equal integer.

Edge cases: null, empty and too short recordings have no fingerprint and align with nothing;
nulls and NaN inside count as silence; repeated rows and rows that share an id are one
recording; rows without an id are left out of alignment; silence has the fingerprint of
silence; ties go to the smallest id; an empty table gives an empty table; recordings of any
length are read as a whole; columns of other names play no part; ids that are no integers are
refused with a TypeError.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, integer_id, join_groups
from .neardup import BLOCK, FEW, Forest, block_pairs

PITCHES, FILTERS, SPAN = 12, 16, 16
#: (frames, first class, classes, kind) by a rule: frames 4, 8, 12, 16; kinds: time halves, class halves, checker, middle.
RULE = [(SPAN * (j // 4 + 1) // 4, (3 * j) % 9, 3 + j % 3 + (j % 2) * 3, j % 4) for j in range(FILTERS)]
RULE = [(w, min(y, PITCHES - h), h, k) for w, y, h, k in RULE]
THRESHOLDS = (-0.15, 0.0, 0.15)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: (mean, standard deviation times the root of the overlap) of the share of differing bits of unrelated recordings, measured on 400,000 pairs.
UNRELATED = (0.398, 0.22)
#: Integers of a block, and offsets times recordings that a kernel correlates at once.
BLOCK_CODES, CELLS = 1 << 16, 1 << 14


def chroma_of_bins(signal: np.ndarray, frame: int = 24) -> np.ndarray:
    """(..., frames, 12) from short signals (..., samples): the magnitudes of a frame's 12 frequency bins, every sample a frame."""
    if signal.shape[-1] < frame:
        return np.zeros((*signal.shape[:-1], 0, PITCHES))
    view = np.lib.stride_tricks.sliding_window_view(signal, frame, axis=-1) * np.hanning(frame)
    return np.abs(np.fft.rfft(view, axis=-1))[..., 1 : PITCHES + 1]


def chroma_of_pcm(samples: np.ndarray, rate: int, frame: int = 4096, hop: int = 1365, low: float = 55.0, high: float = 3520.0) -> np.ndarray:
    """(frames, 12) from audio samples: energies of the bins between two pitches, by pitch class."""
    if len(samples) < frame:
        return np.zeros((0, PITCHES))
    view = np.lib.stride_tricks.sliding_window_view(samples.astype(float), frame)[::hop] * np.hamming(frame)
    power = np.abs(np.fft.rfft(view, axis=1)) ** 2
    hz = np.fft.rfftfreq(frame, 1 / rate)
    use = np.flatnonzero((hz >= low) & (hz <= high))
    pitch = np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % PITCHES
    out = np.zeros((len(view), PITCHES))
    for c in range(PITCHES):
        out[:, c] = power[:, use[pitch == c]].sum(1)
    return out


def fingerprint(chroma: np.ndarray) -> np.ndarray:
    """Packed integers (uint32), one for each position of SPAN frames; of one recording or of several of one length."""
    n = chroma.shape[-2] - SPAN + 1
    if n < 1:
        return np.zeros((*chroma.shape[:-2], 0), np.uint32)
    norm = np.linalg.norm(chroma, axis=-1, keepdims=True)
    x = np.log1p(np.where(norm > 1e-9, chroma / np.maximum(norm, 1e-9), 0.0))
    total = np.zeros((*x.shape[:-2], x.shape[-2] + 1, PITCHES + 1))
    total[..., 1:, 1:] = x.cumsum(-2).cumsum(-1)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        late, early = total[..., t1 : t1 + n, :], total[..., t0 : t0 + n, :]
        return late[..., y1] - early[..., y1] - late[..., y0] + early[..., y0]

    out = np.zeros((*x.shape[:-2], n), np.uint32)
    for w, y, h, kind in RULE:
        whole = area(0, w, y, y + h)
        m, v = w // 2, h // 2
        if kind == 0:
            plus = area(0, m, y, y + h)
        elif kind == 1:
            plus = area(0, w, y, y + v)
        elif kind == 2:
            plus = area(0, m, y, y + v) + area(m, w, y + v, y + h)
        else:
            plus = area(w // 4, w - w // 4, y, y + h)
        value = np.log1p(plus) - np.log1p(whole - plus)
        out = (out << np.uint32(2)) | GRAY[np.digitize(value, THRESHOLDS)]
    return out


#: Samples that a task turns into fingerprints at once; a longer recording is taken alone.
SAMPLES = 1 << 17


def fingerprints(recordings: DataFrame, key: str, samples: str, rate: int | None = None) -> DataFrame:
    """(id, codes array<long>) of rows with arrays of samples; without a rate they are short signals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                b = batch.slice(i, 1000)
                signals = b.column(1).fill_null([])
                off, flat = signals.offsets.to_numpy(), np.nan_to_num(signals.values.fill_null(0.0).to_numpy(zero_copy_only=False))
                sizes, out = np.diff(off), [None] * len(b)
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)  # recordings of one length go together
                    step = max(1, SAMPLES // max(1, int(size))) if rate is None else 1
                    for k in range(0, len(rows), step):
                        part = rows[k : k + step]
                        x = np.stack([flat[off[r] : off[r + 1]] for r in part])
                        codes = fingerprint(chroma_of_bins(x)) if rate is None else fingerprint(chroma_of_pcm(x[0], rate))[None]
                        for r, c in zip(part, codes.astype(np.int64)):
                            out[r] = c
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["id", "codes"])

    rows = recordings.select(integer_id(recordings, key).alias("id"), F.col(samples).cast("array<double>"))
    return rows.mapInArrow(run, "id long, codes array<long>")


def allowed(n: Column, max_error: float, z: float | None) -> Column:
    """The largest share of differing bits at an overlap of n; without z only max_error counts."""
    return F.lit(max_error) if z is None else F.least(F.lit(max_error), UNRELATED[0] - z * UNRELATED[1] / F.sqrt(n))


def aligned(pairs: DataFrame, codes: DataFrame, max_error: float, min_overlap: int, z: float | None = None) -> DataFrame:
    """pairs(a, b, shift, votes) with n and error, where b's codes from ``shift`` on match a's; shift may be negative."""
    both = pairs.join(codes.select(F.col("id").alias("a"), F.col("codes").alias("x")), "a").join(codes.select(F.col("id").alias("b"), F.col("codes").alias("y")), "b")
    n = F.least(F.size("x") - F.greatest(-F.col("shift"), F.lit(0)), F.size("y") - F.greatest("shift", F.lit(0)))
    both = both.withColumn("n", n).where(F.col("n") >= min_overlap)
    x, y = F.slice("x", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.col("n")), F.slice("y", F.greatest("shift", F.lit(0)) + 1, F.col("n"))
    bits = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return both.withColumn("error", bits / (32 * F.col("n"))).where(F.col("error") <= allowed(F.col("n"), max_error, z)).select("a", "b", "shift", "votes", "n", "error")


def forest_in_block(max_error: float, min_overlap: int):
    """Kernel of a block pair of one integer: codes are laid so that its positions meet; keeps a spanning forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = pdf["id"].to_numpy(), pdf["t"].to_numpy()
        codes = [np.asarray(x, np.int64) for x in pdf["codes"]]
        left, right = at.max(), max(len(c) - t for c, t in zip(codes, at))
        grid, real = np.zeros((len(ids), left + right), np.uint32), np.zeros((len(ids), left + right), bool)
        for i, (c, t) in enumerate(zip(codes, at)):
            grid[i, left - t : left - t + len(c)], real[i, left - t : left - t + len(c)] = c, True
        forest = Forest(len(ids))
        forest.label = np.unique(pdf["c"].to_numpy(), return_inverse=True)[1]
        out: list[tuple[int, int]] = []
        for i in range(len(ids)):
            rest = np.flatnonzero(forest.label != forest.label[i])
            if not len(rest):
                break
            both = real[rest] & real[i]
            n = both.sum(1)
            wrong = np.where(both, np.bitwise_count(grid[rest] ^ grid[i]), 0).sum(1, dtype=np.int64)
            near = rest[(n >= min_overlap) & (wrong <= max_error * 32 * n)]
            out += [(ids[i], ids[j]) for j in forest.join(i, near)] if len(near) else []
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def offset_histogram(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, shift, votes): how often codes of a and b are equal at each offset; both are (code, id, t)."""
    a, b = left.select("code", F.col("id").alias("a"), F.col("t").alias("ta")), right.select("code", F.col("id").alias("b"), F.col("t").alias("tb"))
    return a.join(b, "code").where("a <> b").groupBy("a", "b", (F.col("tb") - F.col("ta")).alias("shift")).agg(F.count("*").alias("votes"))


def smooth(n: int) -> int:
    """The least length from n on with no prime factor above 5."""
    while True:
        m = n
        for f in (2, 3, 5):
            while m % f == 0:
                m //= f
        if m == 1:
            return n
        n += 1


def spectra(codes: list[np.ndarray], size: int) -> np.ndarray:
    """(frequencies, recordings, 32) of the codes' bits as plus and minus one, zero beyond the end."""
    x = np.zeros((len(codes), 32, size), np.float32 if size <= 4096 else np.float64)
    for i, c in enumerate(codes):
        x[i, :, : len(c)] = 1 - 2 * ((c[None] >> np.arange(32, dtype=np.uint32)[:, None]) & np.uint32(1)).astype(np.int8)
    return np.fft.rfft(x, axis=2).transpose(2, 0, 1)


def inverse(shifts: np.ndarray, size: int) -> np.ndarray:
    """(offsets, 2 * frequencies): from real and imaginary parts of a product of spectra to the correlation at each offset."""
    f = np.arange(size // 2 + 1)
    turn, weight = 2 * np.pi * np.outer(shifts, f) / size, np.where((f == 0) | (2 * f == size), 1, 2) / size
    return np.hstack([np.cos(turn) * weight, -np.sin(turn) * weight]).astype(np.float32)


def correlated(left: list[np.ndarray], right: list[np.ndarray], max_error: float, min_overlap: int) -> np.ndarray:
    """Which of left and right are aligned at any offset, by correlation of their bits at all of them."""
    n, m = (np.array([len(c) for c in x]) for x in (left, right))
    low, high = min_overlap - n.max(), m.max() - min_overlap
    out = np.zeros((len(n), len(m)), bool)
    if low > 0 or high < 0:
        return out
    size = smooth(int(n.max() + m.max() - min_overlap))
    overlap = np.arange(min(n.max(), m.max()) + 1)
    least = np.where(overlap >= min_overlap, 32 * overlap - 2 * np.floor(max_error * 32 * overlap) - 0.5, np.inf)
    shifts = np.arange(low, high + 1)
    back = inverse(shifts, size) if size <= 256 else None
    step = max(1, CELLS // size)
    for i in range(0, len(n), step):
        x, own = spectra(left[i : i + step], size).conj(), n[i : i + step]
        for j in range(0, len(m), step):
            z, other = x @ spectra(right[j : j + step], size).transpose(0, 2, 1), m[j : j + step]
            if back is not None:
                r = (back @ np.concatenate([z.real, z.imag]).reshape(len(z) * 2, -1)).reshape(len(shifts), len(own), len(other))
            else:
                r = np.fft.irfft(z, size, axis=0)[shifts % size]
            a, b = (x[:1] if (x == x[0]).all() else x for x in (own, other))
            hit = out[i : i + step, j : j + step]
            for k, shift in enumerate(shifts):
                hit |= r[k] >= least[np.maximum(0, np.minimum((a + min(0, shift))[:, None], (b - max(0, shift))[None]))]
    return out


def links_in_block(max_error: float, min_overlap: int):
    """Kernel of a block pair: tests all its pairs at all offsets; gives the links of each id and a spanning forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        ids, place = np.unique(pdf["id"].to_numpy(), return_inverse=True)
        codes = [np.asarray(x, np.int64).astype(np.uint32) for x in pdf["codes"]]
        order = np.argsort([len(c) for c in codes], kind="stable")
        sides = [order[(pdf["own"].to_numpy() == side)[order]] for side in (p, q)]
        # runs of similar length, so that few are padded far
        runs = [np.split(s, np.flatnonzero(np.diff([len(codes[i]).bit_length() for i in s])) + 1) if len(s) else [] for s in sides]
        link = np.zeros((len(ids), len(ids)), bool)
        for k, x in enumerate(runs[0]):
            for y in runs[1][k if p == q else 0 :]:
                i, j = np.nonzero(correlated([codes[t] for t in x], [codes[t] for t in y], max_error, min_overlap))
                link[place[x[i]], place[y[j]]] = True
        link |= link.T
        np.fill_diagonal(link, False)
        forest, out = Forest(len(ids)), []
        for i in range(len(ids)):
            near = np.flatnonzero(link[i])
            out += [(ids[i], ids[j], 0) for j in forest.join(i, near)] if len(near) else []
        out += [(ids[i], ids[i], c) for i, c in enumerate(link.sum(1)) if c]
        return pd.DataFrame(out, columns=["a", "b", "links"], dtype="int64")

    return run


def indexed_links(codes: DataFrame, max_error: float, min_overlap: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) and (u, links) kept while the pairs with an equal integer at their offset become connected."""
    at = codes.select("id", F.posexplode("codes").alias("t", "code"))
    firsts = at.groupBy("code").agg(F.min(F.struct("id", "t")).alias("f"), F.max("id").alias("last"), F.count("*").alias("members")).where("f.id < last")
    shared = cut(at.join(firsts.drop("last"), "code"))
    leaders = firsts.select("code", F.col("f.id").alias("id"), F.col("f.t").alias("t"))
    stars = cut(aligned(offset_histogram(leaders, shared.select("code", "id", "t")), codes, max_error, min_overlap))
    label = components(stars)
    known = shared.join(label, "id", "left").withColumn("c", F.coalesce("component", "id"))
    parts = known.groupBy("code").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("code")
    rest = cut(known.join(parts, "code").select("code", "id", "t", "c", "members"))
    few = rest.where(F.col("members") <= FEW)
    few = few.select("code", F.col("id").alias("a"), F.col("t").alias("ta"), F.col("c").alias("ca")).join(few.select("code", F.col("id").alias("b"), F.col("t").alias("tb"), F.col("c").alias("cb")), "code")
    few = few.where("a < b and ca <> cb").groupBy("a", "b", (F.col("tb") - F.col("ta")).alias("shift")).agg(F.count("*").alias("votes"))
    found = aligned(few, codes, max_error, min_overlap)
    many = block_pairs(rest.where(F.col("members") > FEW).withColumn("blocks", F.ceil(F.col("members") / BLOCK)), "blocks").join(codes, "id")
    forest = many.groupBy("code", "p", "q").applyInPandas(forest_in_block(max_error, min_overlap), "a long, b long")
    edges = cut(stars.select("a", "b").unionByName(found.select("a", "b")).unionByName(forest).distinct())
    links = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct().groupBy("u").agg(F.count("*").alias("links"))
    return edges, links


def every_link(codes: DataFrame, max_error: float, min_overlap: int) -> tuple[DataFrame, DataFrame]:
    """A spanning forest (a, b) of all aligned pairs, and (u, links) with the number of ids each is aligned with."""
    blocks = max(1, -(-(codes.agg(F.sum(F.size("codes"))).first()[0] or 0) // BLOCK_CODES))
    pairs = block_pairs(codes.withColumn("blocks", F.lit(blocks)), "blocks").select("p", "q", "id", "own", "codes")
    found = cut(pairs.groupBy("p", "q").applyInPandas(links_in_block(max_error, min_overlap), "a long, b long, links long"))
    edges = found.where("a <> b").select("a", "b").distinct()
    links = found.where("a = b").groupBy(F.col("a").alias("u")).agg(F.sum("links").alias("links"))
    return edges, links


def recordings_aligned(recordings: DataFrame, key: str, samples: str, rate: int | None = None, max_error: float = 0.15, min_overlap: int = 13, every: bool = False) -> DataFrame:
    """(key, n_codes, class_id, links, component_id) of every row.

    class_id: smallest id with the same fingerprint; component_id: smallest id reachable.
    With ``every``, all pairs are tested at all offsets and links is the number of classes the
    class is aligned with. Without, only pairs with an equal integer at the offset are found,
    and links are those kept while components were built.
    """
    rows = cut(fingerprints(recordings, key, samples, rate).withColumn("own", F.sha2(F.concat_ws(",", F.col("codes").cast("array<string>")), 256)))
    full = rows.where(F.col("id").isNotNull() & (F.size("codes") > 0))
    classes = full.groupBy("own").agg(F.min("id").alias("first"))
    member = cut(full.select("id", "own").distinct().join(classes, "own").select("id", "first"))
    codes = cut(full.join(classes.withColumnRenamed("own", "o"), (F.col("own") == F.col("o")) & (F.col("id") == F.col("first"))).select("id", "codes").dropDuplicates())
    edges, links = (every_link if every else indexed_links)(codes, max_error, min_overlap)
    label = components(edges.unionByName(member.select(F.col("first").alias("a"), F.col("id").alias("b"))))
    least = member.groupBy("id").agg(F.min("first").alias("class_id"))
    least = least.join(label.withColumnRenamed("id", "l"), F.col("id") == F.col("l"), "left").join(links, F.col("class_id") == F.col("u"), "left")
    least = least.select(F.col("id").alias("of"), "class_id", F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    out = rows.join(least, F.col("id") == F.col("of"), "left")
    return out.select(F.col("id").alias(key), F.size("codes").cast("long").alias("n_codes"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component_id"))


#: Positions from the first integer of a key to its second, and the ways to leave out two of the four bytes.
REACH, LEFT_OUT = 6, [(0xFF << 8 * a) | (0xFF << 8 * b) for a, b in combinations(range(4), 2)]


def keys(codes: DataFrame) -> DataFrame:
    """(key, id, t): the integers at t and REACH further without two of their bytes; what repeats the position before has none."""
    pair = lambda i: F.struct(F.get("codes", i).alias("p"), F.get("codes", i + REACH).alias("q"))
    at = codes.select("id", F.posexplode(F.transform("codes", lambda _, i: F.struct(pair(i).alias("now"), F.when(i > 0, pair(i - 1)).alias("before")))).alias("t", "x"))
    at = at.where(F.col("x.now.q").isNotNull() & ~F.col("x.now").eqNullSafe(F.col("x.before")))
    without = lambda c, gone: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF ^ gone))
    each = F.array(*(F.xxhash64(F.lit(k), without("x.now.p", gone), without("x.now.q", gone)) for k, gone in enumerate(LEFT_OUT)))
    return at.select(F.explode(each).alias("key"), "id", "t")


def spots(flat: np.ndarray, off: np.ndarray, rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, row, t) of the keys of rows, as ``keys`` makes them, with the row's group in the value."""
    row = np.repeat(rows, np.diff(off)[rows])
    t = np.arange(len(row)) - np.repeat(np.cumsum(np.diff(off)[rows]) - np.diff(off)[rows], np.diff(off)[rows])
    full = t + REACH < np.diff(off)[row]
    row, t = row[full], t[full]
    at = off[row] + t
    new = (t == 0) | (flat[at] != flat[at - 1]) | (flat[at + REACH] != flat[at - 1 + REACH])
    row, t, at = row[new], t[new], at[new]
    byte = [(flat >> np.uint32(8 * i)) & np.uint32(0xFF) for i in range(4)]
    out = []
    for k, (i, j) in enumerate(combinations(range(4), 2)):  # the two bytes that stay
        half = (byte[i] << np.uint32(8) | byte[j]).astype(np.uint64)
        out.append(half[at] << np.uint64(16) | half[at + REACH] | np.uint64(k) << np.uint64(32) | group[row].astype(np.uint64) << np.uint64(35))
    return np.concatenate(out), np.tile(row, len(out)), np.tile(t, len(out))


def histograms(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, shift, votes) of the rows a of left (sorted by value) and b of right with equal keys, from at most about ``most`` hits at once."""
    low, high = (np.searchsorted(left[0], right[0], side) for side in ("left", "right"))
    hit = np.flatnonzero(high > low)
    right, low, n = [x[hit] for x in right], low[hit], (high - low)[hit]

    def shifts(part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = n[part]
        x = np.repeat(low[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return left[1][x], np.repeat(right[1][part], size), np.repeat(right[2][part], size) - left[2][x]

    if not len(hit):
        return
    if n.sum() > most:
        for side in (right, left):
            rows = np.unique(side[1])
            if len(rows) > 1:
                upper = side[1] >= rows[len(rows) // 2]
                for half in (~upper, upper):
                    part = [x[half] for x in side]
                    yield from histograms(left, part, most) if side is right else histograms(part, right, most)
                return
        least = -int(left[2].max())  # one pair: its histogram is summed over parts of its hits
        votes = np.zeros(int(right[2].max()) - least + 1, np.int64)
        for part in np.array_split(np.arange(len(n)), -(-int(n.sum()) // most)):
            if len(part):
                votes += np.bincount(shifts(slice(part[0], part[-1] + 1))[2] - least, minlength=len(votes))
        shift = np.flatnonzero(votes)
        yield np.full(len(shift), left[1][0]), np.full(len(shift), right[1][0]), shift + least, votes[shift]
        return
    a, b, shift = shifts(slice(None))
    order = np.lexsort((shift, b, a))
    a, b, shift = a[order], b[order], shift[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(shift) != 0))))
    yield a[first], b[first], shift[first], np.diff(np.append(first, len(a)))


def wrong_bits(flat: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The number of differing bits of the n codes from x and from y on."""
    out, i = np.zeros(len(n), np.int64), 0
    end = np.cumsum(n)
    while i < len(n):
        done = end[i] - n[i]
        j = max(i + 1, int(np.searchsorted(end, done + most, "right")))
        size = n[i:j]
        place = np.arange(size.sum()) - np.repeat(end[i:j] - size - done, size)
        out[i:j] = np.add.reduceat(np.bitwise_count(flat[np.repeat(x[i:j], size) + place] ^ flat[np.repeat(y[i:j], size) + place]).astype(np.int64), end[i:j] - size - done)
        i = j
    return out


def of_each(rows: list[np.ndarray], ids: np.ndarray) -> list[np.ndarray]:
    """The best of each a of (a, b, shift, votes, n, error, links), with the sum of its links."""
    a, b, _, votes, _, error, links = rows
    if not len(a):
        return rows
    best = np.lexsort((ids[b], error, -votes, a))
    first = np.flatnonzero(np.concatenate(([True], np.diff(a[best]) != 0)))
    return [x[best][first] for x in rows[:-1]] + [np.add.reduceat(links[best], first)]


def aligned_in_groups(max_error: float, min_overlap: int, z: float | None, min_votes: int, summed: bool):
    """Kernel of groups of queries and what may be aligned with them.

    Gives their aligned pairs, each with its best offset, or with ``summed`` the number and the
    best of each query's.
    """

    def run(table: pa.Table) -> pa.Table:
        group = np.unique(np.stack([table[c].to_numpy() for c in ("pack", "part")]), axis=1, return_inverse=True)[1].ravel()
        ids, asked = table["id"].to_numpy(), table["asked"].to_numpy()
        lists = table["codes"].combine_chunks()
        off = lists.offsets.to_numpy().astype(np.int64)
        flat, off = lists.values.to_numpy()[off[0] : off[-1]].astype(np.uint32), off - off[0]
        size = np.diff(off)
        left = spots(flat, off, np.flatnonzero(asked), group)
        order = np.argsort(left[0], kind="stable")
        found: list[list[np.ndarray]] = []
        for a, b, shift, votes in histograms([x[order] for x in left], spots(flat, off, np.flatnonzero(~asked), group), HITS):
            n = np.minimum(size[a] - np.maximum(-shift, 0), size[b] - np.maximum(shift, 0))
            use = (votes >= min_votes) & (n >= max(1, min_overlap)) & (ids[a] != ids[b])
            a, b, shift, votes, n = (x[use] for x in (a, b, shift, votes, n))
            error = wrong_bits(flat, off[a] + np.maximum(-shift, 0), off[b] + np.maximum(shift, 0), n, HITS) / (32 * n)
            use = error <= (max_error if z is None else np.minimum(max_error, UNRELATED[0] - z * UNRELATED[1] / np.sqrt(n)))
            rows = [x[use] for x in (a, b, shift, votes, n, error)]
            best = np.lexsort((rows[2], rows[5], -rows[3], rows[1], rows[0]))
            rows = [x[best] for x in rows]
            rows = [x[np.concatenate(([True], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)))[: len(x)]] for x in rows]
            rows.append(np.ones(len(rows[0]), np.int64))
            found.append(of_each(rows, ids) if summed else rows)
        rows = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 7
        a, b, shift, votes, n, error, links = of_each(rows, ids) if summed else rows
        columns = [(ids[a], "int64"), (links, "int64"), (ids[b], "int64"), (shift, "int32"), (votes, "int64"), (n, "int32"), (error, "float64")]
        return pa.table([pa.array(x.astype(t)) for x, t in columns], names=["a", "links", "b", "shift", "votes", "overlap", "error"])

    return run


#: Codes of a pack of queries and of a part of what may be aligned with it, and hits or codes that a kernel holds at once.
PACK_CODES, PART_CODES, HITS = 1 << 17, 1 << 14, 1 << 20
#: Rounds in which queries move to a larger pack that has one in KEYS_IN or more of their keys.
MOVES, KEYS_IN = 2, 4


def packs_of(left: DataFrame) -> DataFrame:
    """(a, pack) of the queries in left(key, a, codes), a written table with the number of their codes.

    Queries are together by the most frequent of their keys that queries of PACK_CODES or fewer
    have (else by the least frequent). Then each moves to the pack that is the largest with most of
    its keys. So near copies share a pack, and what has their keys meets that and not each
    query. Packs of more than PACK_CODES are dealt to several.
    """
    n, key = F.col("n"), F.col("key")
    of = left.join(left.groupBy("key").agg(F.sum("codes").alias("n")), "key")
    packs = of.groupBy("a").agg(F.max_by("key", F.struct(F.when(n <= PACK_CODES, n).otherwise(-n), key)).alias("pack"), F.count("*").alias("keys"), F.max("codes").alias("codes"))
    for _ in range(MOVES):
        sized = cut(packs.join(packs.groupBy("pack").agg(F.sum("codes").alias("n")), "pack"))
        largest = left.join(sized.select("a", "pack", "n"), "a").groupBy("key").agg(F.max(F.struct("n", "pack")).alias("m"))
        to = left.join(largest, "key").groupBy("a", "m").agg(F.count("*").alias("shared")).groupBy("a").agg(F.max(F.struct("shared", "m.n", "m.pack")).alias("to"))
        move = (F.col("to.shared") * KEYS_IN >= F.col("keys")) & (F.col("to.n") > n)
        packs = sized.join(to, "a").select("a", F.when(move, F.col("to.pack")).otherwise(F.col("pack")).alias("pack"), "keys", "codes")
    packs = cut(packs)
    packs = packs.join(packs.groupBy("pack").agg(F.sum("codes").alias("n")), "pack")
    return packs.select("a", F.xxhash64("pack", F.pmod(F.xxhash64("a", F.lit("pack")), F.ceil(n / PACK_CODES))).alias("pack"))


def search(recordings: DataFrame, key: str, samples: str, queries: Column, rate: int | None, max_error: float, min_overlap: int, z: float | None, min_votes: int, summed: bool) -> tuple[DataFrame, DataFrame]:
    """``alignments``, or with ``summed`` ``best_alignments``.

    Key hits are not rows. Queries with frequent keys in common are packs; a recording meets a
    pack if ``min_votes`` or more of its keys are in it, as it has no alignment otherwise. A pack
    and a part of what it meets go to a kernel, which makes the hits again from the codes.
    """
    rows = cut(fingerprints(recordings.where(F.col(key).isNotNull()), key, samples, rate).withColumn("own", F.sha2(F.concat_ws(",", F.col("codes").cast("array<string>")), 256)))
    asked = recordings.where(queries).select(integer_id(recordings, key).alias("q")).distinct()
    each = rows.groupBy("id").agg(F.min(F.struct("own", "codes")).alias("r")).select("id", "r.own", F.size("r.codes").alias("n_codes"))
    first = each.where("n_codes > 0").groupBy(F.col("own").alias("of")).agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    members = each.join(first, F.col("own") == F.col("of"), "left").join(asked, F.col("id") == F.col("q"), "left")
    members = cut(members.select("id", "n_codes", F.coalesce("first", "id").alias("class_id"), F.coalesce("rows", F.lit(1)).alias("rows"), F.col("q").isNotNull().alias("asked")))
    reps = members.where("n_codes > 0 and id = class_id").select(F.col("id").alias("rep"))
    codes = cut(rows.join(reps, F.col("id") == F.col("rep")).groupBy("id").agg(F.min(F.struct("own", "codes")).alias("r")).select("id", "r.codes"))
    wanted = members.where("asked and n_codes > 0").select(F.col("class_id").alias("want")).distinct()
    left = keys(codes.join(wanted, F.col("id") == F.col("want"), "left_semi")).select("key", "id").distinct()
    left = cut(left.join(members.select("id", "n_codes"), "id").select("key", F.col("id").alias("a"), F.col("n_codes").alias("codes")))
    packs = cut(packs_of(left))
    met = keys(codes).select("key", "id").join(left.join(packs, "a").select("key", "pack").distinct(), "key")
    met = met.groupBy("pack", "id").agg(F.count("*").alias("n")).where(F.col("n") >= min_votes).select("pack", "id")
    met = cut(met.join(members.select("id", "n_codes"), "id"))
    parts = met.groupBy("pack").agg(F.count("*").alias("met"), F.sum("n_codes").alias("codes"))
    parts = cut(parts.select("pack", "met", "codes", F.ceil(F.col("codes") / PART_CODES).alias("parts")))
    bins = max(1, -(-2 * (parts.agg(F.sum("codes")).first()[0] or 0) // PART_CODES))
    right = join_groups(met.select("pack", "id"), parts.select("pack", "met", "parts"), "pack", "met").select("pack", F.pmod(F.xxhash64("id", F.lit("part")), "parts").alias("part"), F.lit(False).alias("asked"), "id")
    own = packs.join(parts, "pack").select("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asked"), F.col("a").alias("id"))
    both = own.unionByName(right).join(codes, "id").withColumn("bin", F.pmod(F.xxhash64("pack", "part"), F.lit(bins)))
    kernel = aligned_in_groups(max_error, min_overlap, z, min_votes, summed)
    return both.groupBy("bin").applyInArrow(kernel, "a long, links long, b long, shift int, votes long, overlap int, error double"), members


def alignments(recordings: DataFrame, key: str, samples: str, queries: Column, rate: int | None = None, max_error: float = 0.15, min_overlap: int = 13, z: float | None = 5.5, min_votes: int = 2) -> tuple[DataFrame, DataFrame]:
    """The search: (pairs, members).

    pairs(a, b, shift, votes, overlap, error): the class a of a query is aligned with the class
    b; b's codes from ``shift`` on match a's. members(id, n_codes, class_id, rows, asked): every
    recording with its class, the smallest id of those with its fingerprint.
    """
    pairs, members = search(recordings, key, samples, queries, rate, max_error, min_overlap, z, min_votes, False)
    return pairs.drop("links"), members


def best_alignments(recordings: DataFrame, key: str, samples: str, queries: Column, rate: int | None = None, max_error: float = 0.15, min_overlap: int = 13, z: float | None = 5.5, min_votes: int = 2) -> tuple[DataFrame, DataFrame]:
    """The search without its pairs: (found, members).

    found(a, links, match_id, shift, votes, overlap, error): how many classes the class a of a
    query is aligned with, and of these alignments the one with the most votes.
    """
    some, members = search(recordings, key, samples, queries, rate, max_error, min_overlap, z, min_votes, True)
    best = F.max_by(F.struct(F.col("b").alias("match_id"), "shift", "votes", "overlap", "error"), F.struct("votes", -F.col("error"), -F.col("b"))).alias("m")
    return some.groupBy("a").agg(F.sum("links").alias("links"), best).select("a", "links", "m.*"), members


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings are the media column here: each vector is a short signal of 64 samples.

    Queries are the rows whose id is divisible by 20, against all rows. One row per query:
    its class, the rows of the class, the number of other classes it is aligned with, and the
    alignment with the most votes.
    """
    found, members = best_alignments(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)
    out = members.where("asked").join(found, F.col("class_id") == F.col("a"), "left")
    return out.select(F.col("id").alias("vec_id"), F.col("n_codes").cast("long").alias("n_codes"), "class_id", F.col("rows").alias("class_rows"), F.coalesce("links", F.lit(0)).alias("links"), "match_id", "shift", "votes", "overlap", F.round("error", 9).alias("error"))
