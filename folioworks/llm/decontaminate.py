"""Operator 3: benchmark decontamination with a BM25 index and block-max WAND.

The items of the benchmark are the index, the passages of all training texts the queries.
Tokens are runs of letters and digits, A-Z lowered. An item's BM25 weights are divided by
the least weight that a leak of it can have: each shingle that a passage lacks can take one
token's weight, so a leak lacks at most the weight of as many of the heaviest tokens as it may
lack shingles. A score of 1 is thus reached by every leak, and none is lost to the search.
An item whose leaks may have next to none of its weight (one of many that differ in a rare word
alone) is found by shingles instead: a leak lacks so few that it has one of any few more, so
the rarest of them are its keys, and every passage with a key is verified.
Passages are windows of two halves; a half is as long as the longest item of a shard, so that
any item lies in a window as a whole; shards hold items of similar length.

Postings are in blocks of ``BLOCK`` items with the block's maximum for each term. Sums of
block maxima over a half's terms, as array operations over a batch of texts, bound each
(window, block); windows with a block that can reach the threshold go through block-max
WAND, which returns every item above the threshold. Each hit is verified: the shares of
the 5-word shingles of the item's question, of its answer (its last sentence) and of the
whole that the passage has. A leak has 0.8 of the whole, or of both parts.

The index is built in shards of at most ``SHARD`` items; as many shards as fit in
``INDEX_BYTES`` are broadcast and searched together, in one pass over the texts.

Edge cases: null or empty texts and items give no row; items with fewer words than a
shingle are compared as one sequence; equal items are all reported; repeated rows, and rows
that share an id, are reported once, with the best overlap; rows without an id play no part;
empty tables give an empty table; other columns play no part, whatever their names; very long
texts are searched window by window, as a whole; ids that are no integers are refused with a
TypeError.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, documents, integer_id, mix, unused, utf8, word_hashes

K1, B = 1.2, 0.75
BLOCK, SHARD, INDEX_BYTES = 8, 2048, 256 << 20
SHINGLE = 5
#: Items whose leaks may have a lower share of their weight than this are found by their rarest shingles.
SURE = 0.05

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def token_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, n + 1 offsets of each text's tokens)."""
    inside = _TOKEN[data]
    at = np.zeros(len(data) + 1, bool)
    at[off] = True
    starts = np.flatnonzero(inside & (at[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (at[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return word_hashes(data, starts, ends), np.searchsorted(starts, off)


def hashes_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return token_hashes(data, np.array([0, len(data)]))[0]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    roll = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        roll = roll * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(roll)]
    return mix(roll)


class Part:
    """The shingles of a question, an answer or a whole item."""

    def __init__(self, h: np.ndarray):
        self.k = min(SHINGLE, len(h))
        self.grams = np.unique(grams(h, self.k)) if self.k else np.zeros(0, np.uint64)

    def share(self, passage: np.ndarray) -> float:
        if not len(self.grams):
            return 1.0
        return float(np.isin(self.grams, grams(passage, self.k)).mean())


def question_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer, what comes before it the question; one sentence is both."""
    parts = re.split(r"(?<=[.?!])\s+|\n+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def least_share(weight: dict[int, float], tokens: np.ndarray, lacked: list[tuple[slice, int]]) -> float:
    """The least share of an item's weight that a passage has if it lacks at most so many shingles of each slice of its tokens.

    Tokens count where they occur first: to lose one, a passage must lack all shingles with it,
    of which each belongs to at most one lost token.
    """
    first = np.zeros(len(tokens))
    seen: set[int] = set()
    for i, t in enumerate(tokens.tolist()):
        if t not in seen:
            seen.add(t)
            first[i] = weight[t]
    gone = sum(np.sort(first[part])[::-1][:n].sum() for part, n in lacked)
    return 1 - gone / sum(weight.values())


class Index:
    def __init__(self, items: list[tuple[int, str]], overlap: float = 0.8):
        items = [(i, t) for i, t in items if t]
        tokens = [(i, t, hashes_of(t)) for i, t in items]
        tokens = sorted(((i, t, h) for i, t, h in tokens if len(h)), key=lambda x: x[0])
        self.items = [i for i, _, _ in tokens]
        self.half = max([32, *(len(h) for _, _, h in tokens)])
        self.whole = [Part(h) for _, _, h in tokens]
        self.sides = [tuple(Part(hashes_of(x)) for x in question_answer(t)) for _, t, _ in tokens]
        self.terms = np.unique(np.concatenate([h for _, _, h in tokens])) if tokens else np.zeros(0, np.uint64)
        n, mean = len(tokens), sum(len(h) for _, _, h in tokens) / max(1, len(tokens))
        df = Counter(t for _, _, h in tokens for t in np.searchsorted(self.terms, np.unique(h)).tolist())
        self.postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.least = np.ones(n)
        loose: dict[int, dict[int, float]] = {}
        may_lack = lambda part: len(part.grams) - math.ceil(overlap * len(part.grams) - 1e-9)
        for at, (_, text, h) in enumerate(tokens):
            own, numbers = {}, np.searchsorted(self.terms, h)
            for t, tf in Counter(numbers.tolist()).items():
                own[t] = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean))
            total = sum(own.values())
            question, answer = self.sides[at]
            asked = len(hashes_of(question_answer(text)[0]))
            both = [(slice(0, asked), may_lack(question)), (slice(asked, None), may_lack(answer))]
            self.least[at] = min(least_share(own, numbers, [(slice(None), may_lack(self.whole[at]))]), least_share(own, numbers, both))
            if self.least[at] < SURE:
                loose[at] = {int(self.terms[t]): w / total for t, w in own.items()}
                continue
            for t, w in own.items():
                self.postings[t].append((at, w / total / self.least[at]))
        self.loose = loose
        self.keys = self.rarest(may_lack)
        self.blocks = -(-n // BLOCK)
        self.block_max = np.zeros((len(self.terms), self.blocks), np.float32)
        for t, p in self.postings.items():
            for at, w in p:
                self.block_max[t, at // BLOCK] = max(self.block_max[t, at // BLOCK], w)
        self.term_max = self.block_max.max(1) if self.blocks else np.zeros(0, np.float32)
        self.known = np.zeros(1 << 20, bool)
        self.known[self.terms >> np.uint64(44)] = True

    def rarest(self, may_lack) -> dict[int, dict[int, list[int]]]:
        """By length of shingle: key shingles and their loose items. A leak has a key of the whole, or one of the question (the answer's, if nothing is asked)."""
        parts = {at: (self.whole[at], next((x for x in self.sides[at] if len(x.grams)), self.whole[at])) for at in self.loose}
        held: dict[int, Counter] = defaultdict(Counter)
        for at in self.loose:
            for part in parts[at]:
                held[part.k].update(part.grams.tolist())
        keys: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for at in self.loose:
            for part in parts[at]:
                for g in sorted(part.grams.tolist(), key=lambda g: (held[part.k][g], g))[: may_lack(part) + 1]:
                    if at not in keys[part.k][g][-1:]:
                        keys[part.k][g].append(at)
        return {k: dict(v) for k, v in keys.items()}

    def keyed(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, np.ndarray]]:
        """hits of the loose items: all windows that hold a key, verified by the caller."""
        found = set()
        for k, table in self.keys.items():
            known = np.sort(np.array(list(table), np.uint64))
            rolled = grams(h, k)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, rolled), len(known) - 1)] == rolled)
            text = np.searchsorted(first, at, side="right") - 1
            whole = at + k <= first[text + 1]
            for p, d in zip(at[whole].tolist(), text[whole].tolist()):
                w = (p - int(first[d])) // self.half
                found.update((d, v, i) for i in table[int(rolled[p])] for v in (w, w - 1) if v >= 0)
        for d, w, i in sorted(found):
            lo = int(first[d]) + w * self.half
            passage = h[lo : min(int(first[d + 1]), lo + 2 * self.half)]
            has = set(passage.tolist())
            yield d, i, sum(v for t, v in self.loose[i].items() if t in has), passage

    @property
    def bytes(self) -> int:
        """About what it takes in memory."""
        return self.block_max.nbytes + self.known.nbytes + 100 * sum(map(len, self.postings.values())) + 100 * sum(len(x) for t in self.keys.values() for x in t.values()) + sum(p.grams.nbytes for p in self.whole) * 2

    def hits(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, np.ndarray]]:
        """(text, item, its share of BM25 weight, the passage's tokens) of all windows and items that may be leaks."""
        term = self.lookup(h)
        for d, lo, hi in self.windows(first, term, 1.0):
            seen = np.unique(term[lo:hi])
            for at, score in self.search(seen[seen >= 0].tolist(), 1.0):
                yield d, at, score * self.least[at], h[lo:hi]
        yield from self.keyed(h, first)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term numbers of hashes, -1 for what no item has."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.known[h >> np.uint64(44)])
        at = np.searchsorted(self.terms, h[maybe])
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == h[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score for the distinct terms reaches the threshold."""
        lists = [[self.postings[t], 0, t] for t in terms if t in self.postings]
        found = []
        while lists:
            lists.sort(key=lambda x: x[0][x[1]][0])
            bound, pivot = 0.0, -1
            for k, (p, at, t) in enumerate(lists):
                bound += float(self.term_max[t])
                if bound >= threshold - 1e-6:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][1]][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][1]][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(float(self.block_max[t, block]) for _, _, t in lists[: pivot + 1]) >= threshold - 1e-6:
                if lists[0][0][lists[0][1]][0] == item:
                    score = sum(p[at][1] for p, at, _ in lists[: pivot + 1])
                    if score >= threshold - 1e-6:
                        found.append((item, score))
                    goal = item + 1
                else:
                    goal = item
            else:  # nothing up to the block's end, or the next list's item, can reach it
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1][0][lists[pivot + 1][1]][0])
                goal = max(goal, item + 1)
            for x in lists[: pivot + 1]:
                while x[1] < len(x[0]) and x[0][x[1]][0] < goal:
                    x[1] += 1
            lists = [x for x in lists if x[1] < len(x[0])]
        return found

    def windows(self, off: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
        """(text, first token, last token) of the windows in which a block's bound reaches the threshold."""
        counts = np.diff(off)
        halves = np.maximum(1, -(-counts // self.half))
        base = np.concatenate(([0], np.cumsum(halves)))
        text = np.repeat(np.arange(len(counts)), counts)
        half = base[text] + (np.arange(len(term)) - off[text]) // self.half
        hit = term >= 0
        pairs = np.unique(half[hit] * len(self.terms) + term[hit])
        of, t = pairs // len(self.terms), pairs % len(self.terms)
        single = np.zeros(base[-1])
        np.add.at(single, of, self.term_max[t])
        # first by the largest weight of any block, then by block
        last = np.zeros(base[-1], bool)
        last[base[1:] - 1] = True
        both = lambda x: x + np.where(last.reshape(-1, *[1] * (x.ndim - 1)), 0, np.concatenate((x[1:], np.zeros_like(x[:1]))))
        open_ = both(single) >= threshold - 1e-4
        need = open_ | np.concatenate(([False], open_[:-1]))
        number = np.cumsum(need) - 1
        keep = need[of]
        of, t = of[keep], t[keep]
        if not len(of):
            return
        sums = np.zeros((number[-1] + 1, self.blocks), np.float32)
        start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        for i in range(0, len(start), 4096):
            s = start[i : i + 4096]
            e = start[i + 4096] if i + 4096 < len(start) else len(of)
            sums[number[of[s]]] = np.add.reduceat(self.block_max[t[s[0] : e]], s - s[0], axis=0)
        rows = np.flatnonzero(open_)
        one = sums[number[rows]]
        two = np.where(last[rows][:, None], 0, sums[np.minimum(number[rows] + 1, len(sums) - 1)])
        for w in rows[(one + two).max(1) >= threshold - 1e-4]:
            d = int(np.searchsorted(base, w, side="right")) - 1
            first = int(off[d] + (w - base[d]) * self.half)
            yield d, first, int(min(off[d + 1], first + 2 * self.half))


def shards(items: list[tuple[int, str]], overlap: float) -> list[list[Index]]:
    """Indexes of items of similar length, in groups that are searched in one pass."""
    sized = sorted(((len(hashes_of(t)), i, t) for i, t in items if t), key=lambda x: x[:2])
    parts: list[list] = []
    for n, i, t in sized:
        # a shard's windows are as long as its longest item: twice the length begins another
        if not parts or len(parts[-1]) == SHARD or n > max(64, 2 * parts[-1][0][0]):
            parts.append([])
        parts[-1].append((n, i, t))
    groups: list[list[Index]] = [[]]
    for part in parts:
        index = Index([(i, t) for _, i, t in part], overlap)
        if groups[-1] and sum(x.bytes for x in groups[-1]) + index.bytes > INDEX_BYTES:
            groups.append([])
        groups[-1].append(index)
    return groups


def leaks(docs: DataFrame, items: DataFrame, overlap: float = 0.8, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, bm25, question_overlap, answer_overlap, overlap), one row for each document and item it leaks."""
    items = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(integer_id(items, item).alias("i"), F.col(item_text).alias("t")).distinct()
    rows = docs.where(F.col(key).isNotNull()).select(integer_id(docs, key).alias("id"), F.col(text).cast("string").alias("text"))
    out = None
    for group in shards([(r.i, r.t) for r in items.collect()], overlap):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches if shared.value else ():
                for i in range(0, batch.num_rows, 512):
                    b = batch.slice(i, 512)
                    h, first = token_hashes(*utf8(b.column(1)))
                    ids, found = b.column(0).to_pylist(), {}
                    for index in shared.value:
                        for d, at, score, passage in index.hits(h, first):
                            whole = index.whole[at].share(passage)
                            q, a = (p.share(passage) for p in index.sides[at])
                            if whole >= overlap or q >= overlap and a >= overlap:
                                k = (ids[d], index.items[at])
                                found[k] = max(found.get(k, (0,)), (whole, q, a, score))
                    if found:
                        cols = zip(*((d, i, s, q, a, w) for (d, i), (w, q, a, s) in found.items()))
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "item", "bm25", "question_overlap", "answer_overlap", "overlap"])

        got = rows.mapInArrow(run, "id long, item long, bm25 double, question_overlap double, answer_overlap double, overlap double")
        out = got if out is None else out.unionByName(got)
    best = F.max(F.struct("overlap", "question_overlap", "answer_overlap", "bm25")).alias("m")
    return out.groupBy("id", "item").agg(best).select(F.col("id").alias(key), F.col("item").alias(item), "m.bm25", "m.question_overlap", "m.answer_overlap", "m.overlap")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.round("overlap", 6).alias("overlap"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    gone = unused("gone", docs)
    ids = bounded(cut(leaks(docs, items).select(F.col("doc_id").alias(gone)).distinct()))
    return docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti")


#: Shares of shingles without the index: a document's, which is a window's where an item was copied as a whole.
OP3_SQL = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
    UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') FROM benchmark),
sizes AS (SELECT DISTINCT least(5, len(w)) AS k FROM t WHERE kind = 'b' AND len(w) > 0),
shingles AS (SELECT DISTINCT kind, id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS g FROM t, sizes WHERE len(w) >= k AND (kind = 'd' OR k = least(5, len(w)))),
totals AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, round(count(*) / any_value(n), 6) AS overlap FROM shingles d JOIN shingles b ON d.kind = 'd' AND b.kind = 'b' AND d.k = b.k AND d.g = b.g JOIN totals ON totals.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n)
"""
