"""Minimal word graphs of lexicons of any size, and words walked over them.

Two prefixes are one state of the minimal graph if the same endings follow them. A state is
thus the set of its endings, and its fingerprint the exclusive or of their hashes (two of 64
bits, and the count), which partial aggregation sums: one grouping minimises the graph, without
rounds over its depth, and no word reaches the driver. Word ends are flags of edges.
States are named after their shortest, then smallest prefix; the root is "".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut


def minimal_graph(words: DataFrame) -> DataFrame:
    """(node, letter, next, eow, last) of the minimal graph of words(word); next is null where all words end.

    Null and empty words are left out, repeated ones count once; no words give no edges.
    """
    known = words.where(F.length("word") > 0).select("word").distinct()
    parts = known.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("n"))
    parts = parts.select(F.expr("left(word, n - 1)").alias("prefix"), F.expr("substring(word, n, 1)").alias("letter"), F.expr("substring(word, n)").alias("rest"))
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), "rest")).alias(f"h{seed}") for seed in (1, 2)]
    nodes = cut(parts.groupBy("prefix").agg(F.count("*").alias("endings"), *hashes))
    same = ["endings", "h1", "h2"]
    shortest = F.min(F.struct(F.length("prefix").alias("n"), "prefix"))
    named = cut(nodes.join(nodes.groupBy(same).agg(shortest.alias("first")), same).select("prefix", F.col("first.prefix").alias("name")))
    edges = parts.groupBy("prefix", "letter").agg(F.max(F.length("rest") == 1).alias("eow"))
    # all prefixes of a state have the same edges: those of its name are enough
    edges = edges.join(named.where("prefix = name").select("prefix"), "prefix", "left_semi")
    most = edges.groupBy("prefix").agg(F.max("letter").alias("most"))
    behind = named.select(F.col("prefix").alias("child"), F.col("name").alias("next"))
    out = edges.join(most, "prefix").join(behind, F.concat("prefix", "letter") == F.col("child"), "left")
    return out.select(F.col("prefix").alias("node"), "letter", "next", "eow", (F.col("letter") == F.col("most")).alias("last"))


def walk(words: DataFrame, graph: DataFrame) -> DataFrame:
    """Distinct words(word) with contains and prefix: all words step along the graph's edges a letter at a time.

    Rounds end when no word is left, so there are as many as the graph's longest word has
    letters, and each shuffles only the words that came so far. The empty word is a prefix; null is neither.
    """
    edges = cut(graph.select("node", "letter", "next", "eow"))
    every = cut(words.select("word").distinct())
    at = every.where("word is not null").select("word", F.lit("").alias("node"), F.lit(False).alias("eow"))
    through, n = [], 0
    while True:
        through.append(at.where(F.length("word") == n).select("word", "eow"))
        on = at.where((F.length("word") > n) & F.col("node").isNotNull()).select("word", "node", F.substring("word", n + 1, 1).alias("letter"))
        at, n = cut(on.join(edges, ["node", "letter"]).select("word", F.col("next").alias("node"), "eow")), n + 1
        if at.isEmpty():
            break
    walked = reduce(DataFrame.unionByName, through).withColumn("prefix", F.lit(True))
    known = lambda c: F.coalesce(c, F.lit(False))
    return every.join(walked, "word", "left").select("word", known("eow").alias("contains"), known("prefix").alias("prefix"))
