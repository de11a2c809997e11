"""Operators over probs(line_id, t, features): decoding, certainties, words, error rates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ctc


def first_max(features: Column) -> Column:
    """Position of the first largest element."""
    return (F.array_position(features, F.array_max(features)) - 1).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable, where a column would be computed at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(features: Column) -> Column:
    """Differences to the largest, cut at -86, exponentiated and divided by their sum."""
    powers = lambda x: let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(F.greatest(F.lit(-86.0), v - m))))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return let(features.cast("array<double>"), lambda x: let(powers(x), lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t))))


def activation(name: str, v: Column) -> Column:
    forms = {
        "Linear": lambda: v,
        "Relu": lambda: F.greatest(v, F.lit(0.0)),
        "PosClip": lambda: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)),
        "SymClip": lambda: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v)),
        "Tanh": lambda: F.tanh(v),
        "Logistic": lambda: 1 / (1 + F.exp(-v)),
    }
    return forms[name]()


def best_codes(probs: DataFrame) -> DataFrame:
    """(line_id, t, code, p)."""
    return probs.select("line_id", "t", first_max(F.col("features")).alias("code"), F.array_max("features").cast("double").alias("p"))


def tiers(probs: DataFrame, blank: int) -> DataFrame:
    """(line_id, t, code, tier): 0 for the two best and the blank, 1 for the next three, else 2; earlier codes win ties."""
    each = probs.select("line_id", "t", F.posexplode("features").alias("code", "p"))
    rank = F.row_number().over(Window.partitionBy("line_id", "t").orderBy(F.desc("p"), "code"))
    tier = F.when((rank <= 2) | (F.col("code") == blank), 0).when(rank <= 5, 1).otherwise(2)
    return each.select("line_id", "t", "code", tier.alias("tier"))


def greedy(probs: DataFrame, blank: int) -> DataFrame:
    """(line_id, idx, code, start, end) of the runs of best codes without blanks: gaps and islands."""
    line = Window.partitionBy("line_id").orderBy("t")
    turn = F.coalesce((F.lag("code").over(line) != F.col("code")).cast("int"), F.lit(1))
    runs = best_codes(probs).withColumn("turn", turn).withColumn("run", F.sum("turn").over(line))
    runs = runs.groupBy("line_id", "run", "code").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end")).where(F.col("code") != blank)
    return runs.select("line_id", (F.row_number().over(Window.partitionBy("line_id").orderBy("run")) - 1).alias("idx"), "code", "start", "end")


def certainty(p: Column) -> Column:
    return F.when(p > math.exp(ctc.MIN_CERTAINTY), F.ln(p)).otherwise(ctc.MIN_CERTAINTY)


def scores(probs: DataFrame, blank: int, ratio: float = 1.0) -> DataFrame:
    """greedy's rows with certainty and rating; each timestep counts to the symbol it leads to, the rest to the last."""
    line = Window.partitionBy("line_id").orderBy("t")
    best = best_codes(probs).withColumn("turn", F.coalesce((F.lag("code").over(line) != F.col("code")).cast("int"), F.lit(1)))
    best = best.withColumn("ends", (F.col("code") != blank) & F.coalesce(F.lead("code").over(line) != F.col("code"), F.lit(True)))
    # the symbol a timestep leads to has as many ends before it as there are before the timestep
    upto = F.sum(F.col("ends").cast("int")).over(line) - F.col("ends").cast("int")
    best = best.withColumn("idx", F.least(upto, F.sum(F.col("ends").cast("int")).over(Window.partitionBy("line_id")) - 1))
    c = (certainty(F.col("p")) + ctc.CERTAINTY_OFFSET) * ratio
    sums = best.where("idx >= 0").groupBy("line_id", F.col("idx").cast("int").alias("idx")).agg(F.least(F.lit(0.0), F.min(c)).alias("certainty"), (-F.sum(c)).alias("rating"))
    return greedy(probs, blank).join(sums, ["line_id", "idx"])


def widths(probs: DataFrame) -> DataFrame:
    return probs.groupBy("line_id").agg(F.count("*").alias("width"))


def boundaries(symbols: DataFrame, width: DataFrame) -> DataFrame:
    """(line_id, k, bound): 0, halfway between neighbours, width; only the width for a line without symbols."""
    line = Window.partitionBy("line_id").orderBy("idx")
    inner = symbols.withColumn("next", F.lead("start").over(line)).where("next is not null")
    inner = inner.select("line_id", (F.col("idx") + 1).alias("k"), (F.col("end") + F.floor((F.col("next") - F.col("end")) / 2)).alias("bound"))
    n = width.join(symbols.groupBy("line_id").agg(F.count("*").alias("n")), "line_id", "left").fillna(0, ["n"])
    ends = n.where("n > 0").select("line_id", F.lit(0).alias("k"), F.lit(0).alias("bound")).unionByName(n.select("line_id", F.col("n").alias("k"), F.col("width").alias("bound")))
    return inner.unionByName(ends).select("line_id", F.col("k").cast("int").alias("k"), F.col("bound").cast("int").alias("bound"))


def texts(symbols: DataFrame, chars: DataFrame, lines: DataFrame) -> DataFrame:
    """(line_id, text, error) of lines(line_id): characters of the codes in order; chars is (code, text).

    A line without symbols has an empty text. A code without a character is an error of its line,
    which then has no text.
    """
    named = symbols.join(F.broadcast(chars), "code", "left")  # one row for each code of a model
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), "")
    each = named.groupBy("line_id").agg(joined.alias("text"), F.min(F.when(F.col("text").isNull(), F.col("code"))).alias("bad"))
    out = lines.select("line_id").join(each, "line_id", "left")
    error = F.when(F.col("bad").isNotNull(), F.concat(F.lit("code "), F.col("bad").cast("string"), F.lit(" stands for no character")))
    return out.select("line_id", F.when(F.col("bad").isNull(), F.coalesce("text", F.lit(""))).alias("text"), error.alias("error"))


def gaps(symbols: DataFrame, space: int) -> DataFrame:
    """symbols with gap, the number of spaces so far: letters of a word share it."""
    return symbols.withColumn("gap", F.sum((F.col("code") == space).cast("int")).over(Window.partitionBy("line_id").orderBy("idx")))


def words(symbols: DataFrame, space: int) -> DataFrame:
    """(line_id, gap, word, first, after, space_certainty) of runs between spaces."""
    line = Window.partitionBy("line_id").orderBy("idx")
    marked = gaps(symbols, space).withColumn("c", F.when(F.col("code") == space, F.col("certainty")))
    marked = marked.withColumn("before", F.last("c", True).over(line)).withColumn("beyond", F.first("c", True).over(line.rowsBetween(0, Window.unboundedFollowing)))
    runs = marked.where(F.col("code") != space).groupBy("line_id", "gap").agg(F.min("idx").alias("first"), (F.max("idx") + 1).alias("after"), F.first("before").alias("before"), F.first("beyond").alias("beyond"))
    beside = F.least(F.coalesce("before", F.lit(0.0)), F.coalesce(F.col("beyond"), F.col("before"), F.lit(0.0)))
    return runs.select("line_id", "gap", (F.row_number().over(Window.partitionBy("line_id").orderBy("gap")) - 1).alias("word"), "first", "after", beside.alias("space_certainty"))


def confidence(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 + 5 * ctc.CERTAINTY_SCALE * c))


def word_boxes(found: DataFrame, bounds: DataFrame, scale: float, box: tuple[int, int, int, int]) -> DataFrame:
    """words' rows with x0, y0, x1, y1 on the page; at least one pixel wide."""
    at = lambda name: bounds.select("line_id", F.col("k").alias(name), F.col("bound").alias(f"{name}_at"))
    both = found.join(at("first"), ["line_id", "first"]).join(at("after"), ["line_id", "after"])
    x0 = box[0] + F.floor(F.col("first_at") * scale)
    x1 = F.greatest(x0 + 1, box[0] + F.ceil(F.col("after_at") * scale))
    return both.select(*found.columns, x0.cast("int").alias("x0"), F.lit(box[1]).alias("y0"), x1.cast("int").alias("x1"), F.lit(box[3]).alias("y1"))


def recognize(probs: DataFrame, chars: DataFrame, blank: int, space: int, scale: float, box: tuple[int, int, int, int]) -> DataFrame:
    """(line_id, word, text, x0, y0, x1, y1, confidence, line_confidence) by best path; a word with a code without a character has no text."""
    scored = scores(probs, blank)
    found = word_boxes(words(scored, space), boundaries(scored, widths(probs)), scale, box)
    letters = gaps(scored, space).where(F.col("code") != space).join(F.broadcast(chars), "code", "left")
    each = found.join(letters.select("line_id", "gap", F.col("idx").alias("i"), "text", "certainty"), ["line_id", "gap"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]), "")
    keys = ["line_id", "word", "x0", "y0", "x1", "y1"]
    out = each.groupBy(*keys).agg(F.when(~F.bool_or(F.col("text").isNull()), joined).alias("text"), F.least(F.lit(0.0), F.min("certainty"), F.min("space_certainty")).alias("c")).withColumn("confidence", confidence(F.col("c")))
    return out.select(*keys, "text", "confidence", F.min("confidence").over(Window.partitionBy("line_id")).alias("line_confidence"))


def lines(probs: DataFrame, chars: DataFrame, blank: int, space: int) -> DataFrame:
    """(line_id, text, n_words, confidence, error) of every line, with its spaces.

    The confidence is that of its worst word; a line without words has 0.
    """
    scored, wide = scores(probs, blank), widths(probs)
    found = words(scored, space).select("line_id", "gap", "space_certainty")
    worst = gaps(scored, space).where(F.col("code") != space).groupBy("line_id", "gap").agg(F.min("certainty").alias("c")).join(found, ["line_id", "gap"])
    each = worst.groupBy("line_id").agg(F.count("*").alias("n_words"), F.min(confidence(F.least(F.lit(0.0), F.col("c"), F.col("space_certainty")))).alias("confidence"))
    out = texts(scored, chars, wide).join(each, "line_id", "left")
    return out.select("line_id", "text", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "error")


def error_rate(got: Column, want: Column) -> Column:
    """Edit distance by characters over the wanted length; an empty want gives 0 or 1."""
    n = F.char_length(want)
    return F.when(n > 0, F.levenshtein(got, want) / n).otherwise((F.char_length(got) > 0).cast("double"))
