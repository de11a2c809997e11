"""Operators over charset(id, text, normed, script, properties), recoder(unichar_id, code),
graph edges and word lists. Tables of a model are small; words are not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon


def parse_charset(lines: DataFrame, value: str = "value", number: str = "line_no", file: str = "file") -> DataFrame:
    """charset of each file from text lines (file, number, value); line 0 holds the count, lines beyond it are ignored."""
    count = lines.where(F.col(number) == 0).select(F.col(file), F.trim(value).cast("int").alias("n"))
    rows = lines.where(F.col(number) > 0).join(count, file).where(F.col(number) <= F.col("n"))
    f = F.split(F.trim(F.substring_index(value, "\t", 1)), r"\s+")
    at = rows.withColumn("f", f).withColumn("s", F.when(F.element_at("f", 3).contains(","), 4).otherwise(3))
    text = F.when(F.element_at("f", 1) == "NULL", " ").otherwise(F.element_at("f", 1))
    normed = F.when(F.size("f") - F.col("s") == 4, F.element_at("f", -1)).otherwise(text)
    return at.select(file, (F.col(number) - 1).cast("int").alias("id"), text.alias("text"), normed.alias("normed"), F.get("f", F.col("s") - 1).alias("script"), F.conv(F.element_at("f", 2), 16, 10).cast("int").alias("properties"))


def has(properties: str, bit: int):
    return F.col(properties).bitwiseAND(F.lit(bit)) != 0


def properties(charset: DataFrame) -> DataFrame:
    bits = {"alpha": lexicon.ALPHA, "lower": lexicon.LOWER, "upper": lexicon.UPPER, "digit": lexicon.DIGIT, "punct": lexicon.PUNCTUATION}
    return charset.select("id", *(has("properties", b).alias(n) for n, b in bits.items()))


def spaced(charset: DataFrame) -> DataFrame:
    return charset.select("id", F.coalesce(~F.col("script").isin(*lexicon.UNSPACED), F.lit(True)).alias("space_delimited"))


def characters(ids: DataFrame, charset: DataFrame) -> DataFrame:
    """ids(id) with text and normed, empty where out of range."""
    return ids.join(F.broadcast(charset.select("id", "text", "normed")), "id", "left").fillna("", ["text", "normed"])


def encode(ids: DataFrame, recoder: DataFrame) -> DataFrame:
    return ids.join(F.broadcast(recoder.withColumnRenamed("unichar_id", "id")), "id", "left")


def decoder(recoder: DataFrame) -> DataFrame:
    """(code, unichar_id): of ids that share a code the highest; codes of 1 to 9 elements."""
    return recoder.where("size(code) between 1 and 9").groupBy("code").agg(F.max("unichar_id").alias("unichar_id"))


def code_range(recoder: DataFrame) -> DataFrame:
    return recoder.agg((F.coalesce(F.max(F.array_max("code")), F.lit(-1)) + 1).alias("code_range"), F.max(F.size("code")).alias("max_code_len"), F.count("*").alias("size"), F.count_distinct(F.get("code", F.lit(0))).alias("first_codes"))


def edge_fields(records: DataFrame, size: int) -> DataFrame:
    """records(..., edge, record) as (..., edge, unichar_id, last, eow, next)."""
    s = lexicon.flag_shift(size)
    flag = lambda bit: F.shiftrightunsigned("record", s).bitwiseAND(F.lit(bit)) != 0
    return records.select(*(c for c in records.columns if c != "record"), F.col("record").bitwiseAND(F.lit((1 << s) - 1)).cast("int").alias("unichar_id"), flag(lexicon.LAST).alias("last"), flag(lexicon.WORD_END).alias("eow"), F.shiftrightunsigned("record", s + lexicon.FLAG_BITS).alias("next"))


def prefix_edges(words: DataFrame) -> DataFrame:
    """(node, letter, next, eow, last) of the prefix tree of words(word); nodes are prefixes."""
    letters = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("n"))
    edges = letters.groupBy(F.expr("substring(word, 1, n - 1)").alias("node"), F.expr("substring(word, n, 1)").alias("letter")).agg(F.max(F.col("n") == F.length("word")).alias("eow"))
    most = edges.groupBy("node").agg(F.max("letter").alias("m"))
    return edges.join(most, "node").select("node", "letter", F.concat("node", "letter").alias("next"), "eow", (F.col("letter") == F.col("m")).alias("last"))


def edge_char(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """wanted(node, letter) with the edge's next and eow, null for none."""
    return wanted.join(edges.select("node", "letter", "next", "eow"), ["node", "letter"], "left")


def lookup(words: DataFrame, edges: DataFrame) -> DataFrame:
    """words(word) with contains and prefix.

    In a prefix tree a word's last edge exists only if the whole walk does, so one join on
    (all letters but the last, the last) replaces a walk. The empty word is a prefix, not a word.
    """
    split = words.withColumn("node", F.expr("left(word, length(word) - 1)")).withColumn("letter", F.expr("right(word, 1)"))
    out = edge_char(split, edges)
    return out.select("word", F.coalesce("eow", F.lit(False)).alias("contains"), (F.col("next").isNotNull() | (F.col("word") == "")).alias("prefix"))


def surroundings(patterns: Sequence[str], letters: set[str]) -> tuple[dict[tuple[str, str], bool], dict[str, bool]]:
    """What punctuation patterns allow around a core, and alone.

    (before, after): whether a word may end there; and the beginnings before a core, likewise.
    A bare core is always allowed.
    """
    whole, around, alone = set(patterns), {("", ""): True}, {}
    for p in whole:
        if not set(p) <= letters | {CORE}:
            raise ValueError(f"a pattern with unknown letters: {p!r}")
        before, core, after = p.partition(CORE)
        alone |= {before[:n]: before[:n] in whole for n in range(1, len(before) + 1)}
        after = after.partition(CORE)[0]
        for n in range(len(after) + 1) if core else ():
            key = before, after[:n]
            around[key] = around.get(key, False) or before + CORE + after[:n] in whole
    return around, alone


#: The place of the word in a punctuation pattern.
CORE = "\0"


def classify(words: DataFrame, graph_words: DataFrame, letters: list[str], punctuation: list[str] | None = None, numbers: list[str] | None = None) -> DataFrame:
    """Distinct words(word) with permuter and valid_end as the automaton of `functions.lexicon` gives them.

    The automaton's state after a word says what the word is made of: punctuation before a
    core, a core (a word or number, whole if punctuation follows) and punctuation after it.
    So each word is taken apart in the ways that the patterns allow, and cores are joined to
    the beginnings of graph_words(word), of which there may be any number. Punctuation alone
    keeps the rank of the longest core that it can be read as. "\\0" in punctuation patterns
    stands for the word, digits in numbers for any digit; patterns and numbers are a model's,
    so they are few. Null and empty words and those with other letters are refused: (0, false).
    """
    around, alone = surroundings(punctuation or (), set(letters))
    digits = "".join(c for c in letters if c.isdigit())
    shape = lambda c: F.translate(c, digits, "0" * len(digits)) if digits else c
    shapes = {"".join("0" if c.isdigit() else c for c in w) for w in numbers or ()}
    begun = {w[:n] for w in shapes for n in range(1, len(w) + 1)}

    every = words.select("word").distinct()
    spelled = (F.length("word") > 0) & (F.translate("word", "".join(letters), "") == "")
    ways = F.array(*(F.struct(F.lit(a).alias("before"), F.lit(b).alias("after"), F.lit(end).alias("may_end")) for (a, b), end in sorted(around.items())))
    readings = F.when(F.col("word").isin(*alone), F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.left("word", n))).otherwise(F.array("word"))
    read = every.select("word", F.explode_outer(F.when(spelled, readings)).alias("part"))
    fits = F.filter(ways, lambda w: (F.length("part") > F.length(w["before"]) + F.length(w["after"])) & F.startswith("part", w["before"]) & F.endswith("part", w["after"]))
    read = read.select("word", "part", F.explode_outer(fits).alias("way"))
    core = F.substring(F.col("part"), F.length("way.before") + 1, F.length("part") - F.length("way.before") - F.length("way.after"))
    read = read.select("word", "part", core.alias("core"), (F.col("way.after") == "").alias("open"), F.col("way.may_end").alias("may_end"))

    starts = graph_words.where(F.length("word") > 0).select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("n"))
    starts = starts.groupBy(F.expr("left(word, n)").alias("core")).agg(F.max(F.col("n") == F.length("word")).alias("whole"))
    read = read.join(starts, "core", "left").withColumn("shape", shape(F.col("core")))
    word, number = F.col("whole") | (F.col("open") & F.col("whole").isNotNull()), F.col("shape").isin(*shapes) | (F.col("open") & F.col("shape").isin(*begun))
    rank = F.when(word, lexicon.SYSTEM_PERM).when(number, lexicon.NUMBER_PERM)
    ends = (F.col("part") == F.col("word")) & F.col("may_end") & (F.coalesce("whole", F.lit(False)) | F.coalesce(F.col("shape").isin(*shapes), F.lit(False)))
    read = read.select("word", F.when(rank.isNotNull(), F.struct(F.length("part").alias("n"), rank.alias("rank"))).alias("best"), ends.alias("ends"))
    out = read.groupBy("word").agg(F.max("best").alias("best"), F.max("ends").alias("ends"))
    punct, closed = F.col("word").isin(*alone), F.col("word").isin(*(w for w, end in alone.items() if end))
    permuter = F.coalesce("best.rank", F.when(punct, lexicon.PUNC_PERM).otherwise(lexicon.NO_PERM))
    refuse = lambda c: F.coalesce(c, F.lit(False))
    return out.select("word", permuter.cast("int").alias("permuter"), (refuse(F.col("ends")) | refuse(closed)).alias("valid_end"))
