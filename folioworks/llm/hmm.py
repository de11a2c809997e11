"""Operator 1: scoring texts with a hidden Markov language model.

Words are counted over all training texts (one row per word and task is shuffled, so what
is gathered grows with the corpus); a word is known by a hash of 64 bits. The most frequent ``SYMBOLS`` words are symbols of their
own; every other word belongs to a class, named by its last letters, and is drawn within it
by its count plus one. A hidden Markov model over symbols, classes and the end of a text has
``states`` latent states. Baum-Welch: expected counts of transitions and emissions come from
exact scaled forward-backward passes over whole texts in every partition, are summed across
partitions by grouped aggregation, and give the next model; ``passes`` rounds cover all
training texts. The first model comes from a bounded sample of whole texts (``init_texts`` and
``init_tokens``, parameters: the driver holds no more), it only replaces a random start. The
scaled forward recursion gives each text's exact likelihood, in double precision.

Counts of the most frequent ``HEAD`` words are broadcast (bounded by the parameter); all
rarer words are looked up by a join on the word, so every count is exact.

Edge cases: a null text is empty and has the end token only; words unknown to training take
the place reserved for them in their class; repeated rows are scored each; rows without an
id train; words tied in frequency are ordered by hash; without training texts all scores come
from the smoothing alone; an empty table gives an empty table; other columns play no part,
whatever their names; very long texts are scored as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, cut, documents, utf8, word_hashes, word_spans

HEAD, SYMBOLS, CLASSES, SUFFIX = 200_000, 16_000, 1_500, 3
#: Entries of a task's counter before it is handed on, tokens of a batch in a pass.
FLUSH, TOKENS = 1_000_000, 500_000
FREQUENCY_STEPS = 64


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, suffix, n + 1 offsets of each text) of the words of a column, A-Z lowered.

    A word is known by 64 bits of hash; its suffix is its last SUFFIX bytes as a number.
    """
    data, off = utf8(column)
    starts, ends, first = word_spans(data, off)
    suffix = np.zeros(len(starts), np.int64)
    for k in range(min(SUFFIX, 7), 0, -1):
        at = ends - k
        suffix = suffix * 256 + np.where(at >= starts, LOWER[data[np.maximum(at, 0)]], 0) if len(data) else suffix
    return word_hashes(data, starts, ends).view(np.int64), suffix, first


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, suffix, c) over all rows of a one-column table; every task hands on sums."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, suffix, c = (np.concatenate(x) for x in zip(*parts))
        word, at, back = np.unique(word, return_index=True, return_inverse=True)
        return word, suffix[at], np.bincount(back, c, len(word)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                word, suffix, _ = words_of(batch.column(0).slice(i, 1000))
                parts.append(merged([(word, suffix, np.ones(len(word)))]))
                held += len(parts[-1][0])
                if held > FLUSH:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["word", "suffix", "c"])
                        parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)], ["word", "suffix", "c"])

    return texts.mapInArrow(run, "word long, suffix long, c long").groupBy("word").agg(F.min("suffix").alias("suffix"), F.sum("c").alias("c"))


def step(c: Column) -> Column:
    """Frequency class of a count: equal ratios."""
    return F.floor(F.log2(c) * FREQUENCY_STEPS + 1e-9)


@dataclass
class Lexicon:
    """What a task must know of the words: everything here is bounded by parameters."""

    total: int = 0  # training tokens with ends
    distinct: int = 0
    ends: int = 0
    head: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # hashes in order, of the most frequent words
    symbol: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # theirs, or that of their class
    log: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10(c + 1)
    member: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # whether in a class
    suffixes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # in order, of the classes
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    class_log: np.ndarray = field(default_factory=lambda: np.zeros(1))  # log10 of a class's counts, types and one
    first_class: int = 0
    unigram: np.ndarray = field(default_factory=lambda: np.ones(2))

    @property
    def end(self) -> int:
        return len(self.unigram) - 1

    @property
    def other(self) -> int:
        return self.end - 1

    def class_of(self, suffix: np.ndarray) -> np.ndarray:
        hit, at = found(self.suffixes, suffix)
        out = np.full(len(suffix), self.other, np.int64)
        out[hit] = self.classes[at[hit]]
        return out


def found(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether it is there, where) of every x in an ordered table."""
    if not len(table):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x, at


def lexicon(vocabulary: DataFrame, ends: int) -> tuple[Lexicon, int]:
    """The bounded tables, and the frequency class from which words are in the head."""
    v = vocabulary.withColumn("s", step(F.col("c")))
    steps = sorted(((r.s, r.n, r.c) for r in v.groupBy("s").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()), reverse=True)
    words, mass = sum(n for _, n, _ in steps), sum(c for _, _, c in steps)

    def least(limit: int) -> int:
        """The lowest frequency class such that those from it on have at most ``limit`` words."""
        out, seen = (steps[0][0] + 1 if steps else 0), 0
        for s, n, _ in steps:
            seen += n
            if seen > limit:
                break
            out = s
        return out

    head_from, symbol_from = least(HEAD), least(SYMBOLS)
    rows = v.where(F.col("s") >= head_from).select("word", "suffix", "c", "s").collect()
    word, suffix, c, s = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    order = np.lexsort((word, -c))
    word, suffix, c, own = word[order], suffix[order], c[order], s[order] >= symbol_from
    rest = v.where(F.col("s") < symbol_from)
    classes = rest.groupBy("suffix").agg(F.sum("c").alias("c"), F.count("*").alias("n")).orderBy(F.desc("c"), "suffix").limit(CLASSES).collect()
    lex = Lexicon(total=mass + ends, distinct=words + (ends > 0), ends=ends, first_class=int(own.sum()))
    other_c = mass - int(c[own].sum()) - sum(r.c for r in classes)
    other_n = words - int(own.sum()) - sum(r.n for r in classes)
    counts = [*c[own].tolist(), *(r.c for r in classes), other_c, ends]
    lex.unigram = (np.array(counts, float) + 1) / (sum(counts) + len(counts))
    lex.class_log = np.log10([*(r.c + r.n + 1.0 for r in classes), other_c + other_n + 1.0])
    named = np.array([r.suffix for r in classes], np.int64)
    lex.suffixes, lex.classes = np.sort(named), lex.first_class + np.argsort(named)
    symbol = np.where(own, np.cumsum(own) - 1, lex.class_of(suffix))
    by = np.argsort(word)
    lex.head, lex.symbol, lex.log, lex.member = word[by], symbol[by], np.log10(c[by] + 1.0), ~own[by]
    return lex, head_from


def encode(rows: DataFrame, lex) -> DataFrame:
    """rows(id, held_out, text) as (id, held_out, n_tokens, n_head, head_log, class_log, member_log, symbols, tail).

    head_log sums log10(c + 1) over the head's words and the end, member_log over those of
    them in classes, class_log the logs of the classes of all words in classes. tail holds
    the words that the head lacks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Lexicon = lex.value
        log = np.zeros(x.end + 1)
        log[x.first_class : x.end] = x.class_log
        end_log = math.log10(x.ends + 1)
        names = ["id", "held_out", "n_tokens", "n_head", "head_log", "class_log", "member_log", "symbols", "tail"]
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                b = batch.slice(i, 1000)
                word, suffix, first = words_of(b.column(2))
                hit, at = found(x.head, word)
                symbol = x.class_of(suffix)
                symbol[hit] = x.symbol[at[hit]]
                known = np.zeros(len(word))
                known[hit] = x.log[at[hit]]
                member = known.copy()
                member[hit] *= x.member[at[hit]]
                text, n = np.repeat(np.arange(b.num_rows), np.diff(first)), b.num_rows
                total = lambda w: np.bincount(text, w, n)  # noqa: B023, E731
                whole = np.insert(symbol, first[1:], x.end).astype(np.uint16)
                cut_at = first + np.arange(n + 1)
                symbols = [whole[cut_at[j] : cut_at[j + 1]].tobytes() for j in range(n)]
                left = np.flatnonzero(~hit)
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(left, first).astype(np.int32)), pa.array(word[left]))
                cols = [np.diff(first) + 1, total(hit).astype(np.int64) + (x.ends > 0), total(known) + end_log, total(log[symbol]), total(member)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, cols), pa.array(symbols, pa.binary()), tail], names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_head long, head_log double, class_log double, member_log double, symbols binary, tail array<long>")


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


class Packed:
    """Sequences side by side: step t of all sequences that are longer than t is one run of rows."""

    def __init__(self, seqs: list[np.ndarray]):
        n = np.array([len(s) for s in seqs])
        self.order = np.argsort(-n, kind="stable")
        n = n[self.order]
        self.active = np.searchsorted(-n, -np.arange(n[0]), side="left")
        self.off = np.concatenate(([0], np.cumsum(self.active)))
        flat = np.concatenate([seqs[i] for i in self.order])
        row = np.repeat(np.arange(len(n)), n)
        t = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        at = self.off[t] + row
        self.symbol = np.empty(len(flat), np.int64)
        self.symbol[at] = flat
        before = self.off[np.maximum(t - 1, 0)] + row
        self.before = np.empty(len(flat), np.int64)
        self.before[at] = before

    def forward(self, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """(scaled forward probabilities, scale) of every row."""
        alpha = m.emit[self.symbol]
        scale = np.empty(len(alpha), alpha.dtype)
        ones = np.ones(alpha.shape[1], alpha.dtype)
        last = None
        for t, a in enumerate(self.active):
            x = alpha[self.off[t] : self.off[t + 1]]
            x *= m.start if last is None else last[:a] @ m.move
            c = x @ ones
            scale[self.off[t] : self.off[t + 1]] = c
            x /= c[:, None]
            last = x
        return alpha, scale

    def loglik(self, m: Model) -> np.ndarray:
        """Natural logarithm of each sequence's probability, in the order given."""
        _, scale = self.forward(m)
        rows = np.concatenate([np.arange(a) for a in self.active])
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(rows, np.log(scale.astype(float)), len(self.order))
        return out

    def expect(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions (Baum-Welch), and the log likelihood."""
        alpha, scale = self.forward(m)
        k = alpha.shape[1]
        w = m.emit[self.symbol]
        w /= scale[:, None]
        gamma = np.empty_like(alpha)
        back = np.ascontiguousarray(m.move.T)
        beta = None
        for t in range(len(self.active) - 1, -1, -1):
            a, at = self.active[t], slice(self.off[t], self.off[t + 1])
            now = np.ones((a, k), np.float32)
            if beta is not None:
                now[: len(beta)] = beta @ back
            np.multiply(alpha[at], now, out=gamma[at])
            w[at] *= now
            beta = w[at]
        first = self.off[1]
        moves = m.move * (alpha[self.before[first:]].T.astype(np.float64) @ w[first:].astype(np.float64)) if len(alpha) > first else np.zeros((k, k))
        emits = np.stack([np.bincount(self.symbol, gamma[:, j], len(m.emit)) for j in range(k)], axis=1)
        return gamma[:first].sum(0, dtype=float), moves, emits, float(np.log(scale.astype(float)).sum())


def batches_of(seqs: list[np.ndarray]) -> Iterator[list[int]]:
    """Positions in groups of like lengths and at most TOKENS tokens (or one sequence)."""
    group, size = [], 0
    for i in sorted(range(len(seqs)), key=lambda i: len(seqs[i])):
        if group and size + len(seqs[i]) > TOKENS:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(seqs[i])
    if group:
        yield group


def maximise(start: np.ndarray, moves: np.ndarray, emits: np.ndarray, unigram: np.ndarray, prior: float = 20.0) -> Model:
    """The next model; counts are joined by ``prior`` tokens of the unigram in each state."""
    k = len(start)
    s = (start + 1) / (start.sum() + k)
    a = (moves + 1) / (moves.sum(1, keepdims=True) + k)
    b = (emits + prior * unigram[:, None]) / (emits.sum(0) + prior)
    return Model(s.astype(np.float32), a.astype(np.float32), np.ascontiguousarray(b.astype(np.float32)))


def sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def initial(seqs: list[np.ndarray], unigram: np.ndarray, states: int, rounds: int) -> Model:
    """Baum-Welch on a few sequences from a random start with states that tend to stay."""
    rnd = np.random.RandomState(5)
    emits = unigram[:, None] * rnd.gamma(1.0, 1.0, (len(unigram), states)) * 1e4
    moves = 1.0 + 8 * np.eye(states)
    m = maximise(np.ones(states), moves * 100, emits, unigram)
    groups = [Packed([seqs[i] for i in g]) for g in batches_of(seqs)]
    for _ in range(rounds if seqs else 0):
        parts = [g.expect(m) for g in groups]
        m = maximise(*(sum(p[i] for p in parts) for i in range(3)), unigram)
    return m


def baum_welch(encoded: DataFrame, model: Model, unigram: np.ndarray) -> Model:
    """One round over all rows of encoded(symbols); sums of expected counts cross the partitions."""
    spark = encoded.sparkSession
    states = len(model.start)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sums = shared.value, None
        for b in batches:
            seqs = sequences(b.column(0))
            for g in batches_of(seqs):
                got = Packed([seqs[i] for i in g]).expect(m)[:3]
                sums = got if sums is None else [x + y for x, y in zip(sums, got)]
        if sums is not None:
            table = np.concatenate((sums[0][None], sums[1], sums[2]))
            at = np.flatnonzero(table.any(1))
            for i in range(0, len(at), 10_000):
                part = at[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(table[part, j]) for j in range(states))], ["at", *(f"s{j}" for j in range(states))])

    partial = encoded.select("symbols").mapInArrow(run, "at long, " + ", ".join(f"s{j} double" for j in range(states)))
    table = np.zeros((1 + states + len(unigram), states))
    for r in partial.groupBy("at").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(states))).collect():
        table[r[0]] = r[1:]
    return maximise(table[0], table[1 : 1 + states], table[1 + states :], unigram)


def score(encoded: DataFrame, model: Model) -> DataFrame:
    """encoded without symbols, with hmm_log: log10 of the probability of the symbols, in double precision."""
    shared = encoded.sparkSession.sparkContext.broadcast(Model(*(x.astype(np.float64) for x in (model.start, model.move, model.emit))))
    names = [n for n in encoded.columns if n != "symbols"]
    rows = encoded.select(*names, "symbols")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = sequences(b.column(len(names)))
            out = np.zeros(len(seqs))
            for g in batches_of(seqs):
                out[g] = Packed([seqs[i] for i in g]).loglik(shared.value) / math.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], [*names, "hmm_log"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "symbols") + ", hmm_log double"
    return rows.mapInArrow(run, schema)


def sample(learn: DataFrame, texts: int, tokens: int) -> list[np.ndarray]:
    """Symbols of some distinct texts of learn(symbols, n_tokens), by hash: at most ``texts`` with at most ``tokens`` together."""
    own = learn.select("symbols", "n_tokens", F.xxhash64("symbols").alias("h"))
    distinct = cut(own.groupBy("h").agg(F.first("n_tokens").alias("n")))  # copies count once
    few = distinct.where(F.col("h").cast("double") + 2.0**63 <= 2.0**64 * min(1.0, 3.0 * texts / max(1, distinct.count())))
    picked, left = [], tokens
    for r in few.orderBy("h").limit(texts).collect():
        if r.n <= left:
            picked.append((r.h,))
            left -= r.n
    if not picked:
        return []
    wanted = learn.sparkSession.createDataFrame(picked, "want long")
    rows = own.join(F.broadcast(wanted), F.col("h") == F.col("want")).groupBy("h").agg(F.first("symbols").alias("symbols"))
    return [np.frombuffer(r.symbols, np.uint16) for r in rows.orderBy("h").collect()]


def language_model(docs: DataFrame, held_out: Column, states: int = 8, passes: int = 2, init_texts: int = 1500, init_tokens: int = 250_000, init_rounds: int = 15, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    train = rows.where(~F.col("held_out"))
    vocabulary = cut(word_counts(train.select("text")))
    ends = train.count()
    lex, head_from = lexicon(vocabulary, ends)
    encoded = cut(encode(rows, spark.sparkContext.broadcast(lex)).withColumn("row", F.monotonically_increasing_id()))
    learn = encoded.where(~F.col("held_out"))
    model = initial(sample(learn, init_texts, init_tokens), lex.unigram, states, init_rounds)
    for _ in range(passes if ends else 0):
        model = baum_welch(learn, model, lex.unigram)
    rare = vocabulary.where(step(F.col("c")) < head_from).select("word", F.log10(F.col("c") + 1).alias("log"))
    tail = encoded.select("row", F.explode("tail").alias("word"))
    sums = tail.join(rare, "word").groupBy("row").agg(F.sum("log").alias("tail_log"), F.count("*").alias("n_tail"))
    out = score(encoded.drop("tail"), model).join(sums, "row", "left").na.fill(0, ["tail_log", "n_tail"])
    per_token = math.log10(lex.total + lex.distinct + 1)
    return out.select(
        F.col("id").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.col("n_tail")).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.col("tail_log") - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("hmm_log") + F.col("member_log") + F.col("tail_log") - F.col("class_log")).alias("score"),
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
