"""Operator 10: line dedup with a log-template tree.

DataFrame functions only. Lines go down a tree of fixed depth: number of tokens, then the
first ``DEPTH`` tokens; tokens with a digit, an at-sign or a scheme are the field ``<*>``
from the start. A line goes down the path of its own leading tokens, which are constants of that
leaf, and also down each path of a token more on which one of these is a field: where fewer than
``min_docs`` documents, or than ``share`` of those whose lines differ only there, have the token.
In a leaf with more than one distinct line, a further token is constant at its place if it
is there in ``min_docs`` documents or more and in ``share`` of the leaf's, else a field; as the
share is relative, a template keeps its fields however many documents have it, and common names
stay fields. Of two fields among the leading tokens only one is seen. A line's template in a
leaf is its constants at their places. A template that recurs in ``min_docs`` documents or more is dropped from
all of them but the one with the smallest id, so that of copies one stays whole. Templates
need ``MIN_TOKENS`` tokens and constants at ``constant`` of the places.

Only hashes of lines and tokens are shuffled. Tokens are read only for one line of each text,
in leaves with more than one. Documents of a place and token are summed map-side and joined
back, so that a hot leaf's tokens are split like any skewed join; leading tokens, which all
lines of a leaf share, are never dealt out.

Edge cases: null texts stay null, empty ones empty; lines of fewer tokens are never
dropped; repeats inside one document are not a recurrence; rows that share an id are one
document; rows without an id neither count nor lose lines; of documents tied for a template
the smallest id keeps it; an empty table gives an empty table; other columns stay as they
are, whatever their names; texts of any length are read as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, documents, is_small, unused

DEPTH, MIN_TOKENS = 3, 3


def plain(line: Column) -> Column:
    """A line with single spaces between tokens; the pattern only runs where it may match."""
    odd = line.contains("  ")
    for c in "\t\r\x0b\x0c":
        odd = odd | line.contains(c)
    return F.trim(F.when(odd, F.regexp_replace(line, "[ \\t\\r\\x0b\\x0c]+", " ")).otherwise(line))


def masked(line: Column) -> Column:
    """A plain line with its fields masked; possessive from a token's start, so each character is read once."""
    field = "(?<![^ ])(?:[^ 0-9@:]|:(?!//))*+(?:[0-9@]|://)[^ ]*"
    return F.when(line.rlike("[0-9@]|://"), F.regexp_replace(line, field, "<*>")).otherwise(line)


def normal(text: Column) -> Column:
    """The lines of a text, normalised. Steps are transforms of their own: each is evaluated once a line."""
    return F.transform(F.transform(F.split(text, "\n"), plain), masked)


def line_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, line, n, lh, leaves) of all lines that may have a template.

    leaves: the leaf of DEPTH constants, then those with a field at one of their places, and
    last the path without a field that these branch from.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.explode(F.transform(normal(F.col(text)), counted)).alias("l"))
    rows = rows.where(F.col("l.n") >= MIN_TOKENS).select("doc", "l.line", "l.n")
    lead = F.split(F.substring_index("line", " ", DEPTH + 1), " ")
    # no token is empty, so an empty one marks a field
    path = lambda depth, field=None: F.xxhash64("n", *(F.lit("") if p == field else F.get(lead, F.lit(p)) for p in range(depth)))
    leaves = [path(DEPTH), *(F.when(F.col("n") > DEPTH, path(DEPTH + 1, p)) for p in (*range(DEPTH), None))]
    return rows.select("doc", "line", "n", F.xxhash64("line").alias("lh"), F.array(*leaves).alias("leaves"))


def counted(line: Column) -> Column:
    """(line, n): n tokens, 0 for an empty line."""
    n = F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1)
    return F.struct(line.alias("line"), n.alias("n"))


def leaf_lines(distinct: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(lh, leaf, place, n, doc, docs, leaf_docs): distinct lines by their leaves with more than one; place is that of the path's field, from 1."""
    paths = distinct.select("docs", F.explode("leaves").alias("leaf"))
    sizes = cut(paths.where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("c"), F.sum("docs").alias("all")).where("c > 1").select("leaf", "all"))
    own = distinct.select("lh", "n", "docs", "first", "leaves", F.get("leaves", F.lit(DEPTH + 1)).alias("leaf")).join(bounded(sizes), "leaf", "left")
    paths = own.select("lh", "n", "docs", "first", F.coalesce("all", "docs").alias("own"), F.posexplode(F.slice("leaves", 1, DEPTH + 1)).alias("place", "leaf"))
    # a leading token is a field among the lines that differ from its line there, by the rule of all other places
    field = F.col("own") < F.greatest(F.lit(min_docs), share * F.col("all"))
    paths = cut(paths.join(bounded(sizes), "leaf").where((F.col("place") == 0) | field).select("lh", "leaf", "place", "n", F.col("first").alias("doc"), "docs"))
    members = cut(paths.groupBy("leaf").agg(F.count("*").alias("c"), F.sum("docs").alias("leaf_docs")).where("c > 1").select("leaf", "leaf_docs"))
    return cut(paths.join(bounded(members), "leaf").select("lh", "leaf", "place", "n", "doc", "docs", "leaf_docs"))


def recurring(docs: DataFrame, lines: DataFrame, min_docs: int, constant: float, share: float, key: str, text: str) -> DataFrame:
    """(lh, first): hashes of the lines whose template recurs, with the document that keeps it. lines: (doc, lh, leaves, n)."""
    # one row for each line and document, then one for each line
    once = lines.groupBy("lh", "doc").agg(F.first("leaves").alias("leaves"), F.first("n").alias("n"))
    distinct = cut(once.groupBy("lh").agg(F.first("leaves").alias("leaves"), F.first("n").alias("n"), F.count("*").alias("docs"), F.min("doc").alias("first")))
    exact = distinct.where(F.col("docs") >= min_docs).select("lh", "first")
    several = leaf_lines(distinct, min_docs, share)
    # one line of each text, where a leaf of its holds several; other documents are not read further
    of = unused("of", docs)
    wanted = cut(several.groupBy("lh", "doc").agg(F.collect_list(F.struct("leaf", "place", "docs", "leaf_docs")).alias("in")))  # four leaves at most
    some = docs.join(bounded(cut(wanted.select(F.col("doc").alias(of)).distinct())), F.col(key) == F.col(of), "left_semi")
    found = line_rows(some, key, text).select("doc", "lh", "line", "n").join(bounded(wanted), ["lh", "doc"])
    # a line may stand in a document more than once
    found = found.groupBy("lh").agg(F.first("in").alias("in"), F.first(F.slice(F.transform(F.split("line", " "), lambda t, p: F.xxhash64(p, t)), DEPTH + 1, F.col("n"))).alias("at"))
    found = found.select("lh", "at", F.explode("in").alias("in"))
    # a path with a field has one token more
    found = cut(found.select("lh", "in.*", F.when(F.col("in.place") == 0, F.col("at")).otherwise(F.slice("at", 2, F.size("at") + 1)).alias("at")))
    tokens = found.select("lh", "leaf", "docs", "leaf_docs", F.explode("at").alias("at"))
    fixed = tokens.groupBy("leaf", "at").agg(F.sum("docs").alias("d"), F.first("leaf_docs").alias("all"))
    fixed = fixed.where((F.col("d") >= min_docs) & (F.col("d") >= share * F.col("all"))).select("leaf", "at")
    constants = tokens.select("lh", "leaf", "at").join(fixed, ["leaf", "at"]).groupBy("lh", "leaf").agg(F.count("*").alias("k"), F.bit_xor("at").alias("x"))
    template = several.select("lh", "leaf", "n", F.col("doc").alias("first"), "docs").join(constants, ["lh", "leaf"], "left")
    template = template.withColumns({"k": F.coalesce("k", F.lit(0)) + DEPTH, "x": F.coalesce("x", F.lit(0))})
    template = cut(template.where((F.col("k") >= MIN_TOKENS) & (F.col("k") >= constant * F.col("n"))))
    kept = template.groupBy("leaf", "k", "x").agg(F.sum("docs").alias("d"), F.min("first").alias("keeper")).where(F.col("d") >= min_docs)
    general = template.join(kept, ["leaf", "k", "x"]).select("lh", F.col("keeper").alias("first"))
    return cut(exact.unionByName(general).groupBy("lh").agg(F.min("first").alias("first")))


def drop_lines(docs: DataFrame, min_docs: int = 2, constant: float = 0.7, share: float = 0.1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with their text without recurring lines, and n_lines and n_dropped (which replace columns of these names)."""
    lines = cut(line_rows(docs, key, text).select("doc", "lh", "leaves", "n"))
    gone = recurring(docs, lines, min_docs, constant, share, key, text)
    hits = cut(lines.join(bounded(gone), "lh").where("doc <> first").select("doc", "lh").distinct())
    few, of, lost, left = is_small(hits), unused("of", docs), unused("lost", docs), unused("left", docs)
    hits = hits.groupBy(F.col("doc").alias(of)).agg(F.collect_set("lh").alias(lost))
    out = docs.join(F.broadcast(hits) if few else hits, F.col(key) == F.col(of), "left")
    hashed = F.zip_with(F.split(F.col(text), "\n"), F.transform(normal(F.col(text)), lambda x: F.xxhash64(x)), lambda x, h: F.struct(x.alias("x"), h.alias("h")))
    kept = F.transform(F.filter(hashed, lambda s: ~F.array_contains(F.col(lost), s["h"])), lambda s: s["x"])
    count = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"))) + 1
    was = F.coalesce(count(F.col(text)), F.lit(0))
    # an explode of one struct keeps the lines from being filtered once for each use
    out = out.withColumn(left, F.explode(F.array(F.when(F.col(lost).isNotNull(), kept))))
    now = F.when(F.col(lost).isNotNull(), F.size(left)).otherwise(was)
    out = out.withColumns({"n_lines": was.cast("long"), "n_dropped": (was - now).cast("long"), text: F.when(F.col(lost).isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text))})
    return out.select(*dict.fromkeys([*docs.columns, "n_lines", "n_dropped"]))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def without_recurring_lines(docs: DataFrame) -> DataFrame:
    """docs with shortened texts; those that lose all their words go."""
    names = docs.columns
    own = {c: unused(f"own_{c}", docs) for c in ("n_lines", "n_dropped") if c in names}  # a corpus' columns of these names stay
    out = drop_lines(docs.withColumnsRenamed(own))
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(own.get(n, n)).alias(n) for n in names))


OP10_SQL = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL),
spaced AS (SELECT doc_id, raw, trim(regexp_replace(translate(raw, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' {2,}', ' ', 'g'), ' ') AS plain FROM raw),
lines AS (SELECT doc_id, raw, regexp_replace(plain, '[^ ]*(?:[0-9@]|://)[^ ]*', '<*>', 'g') AS line FROM spaced WHERE plain <> ''),
rows AS (SELECT doc_id, line, string_split(line, ' ') AS tokens, len(string_split(line, ' ')) AS n FROM lines),
few AS (SELECT * FROM rows WHERE n >= 3),
distinct_lines AS (SELECT line, any_value(tokens) AS tokens, any_value(n) AS n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM few GROUP BY line),
all_paths AS (SELECT *, n::VARCHAR || ' ' || CASE WHEN place = 1 THEN '' ELSE tokens[1] END || ' ' || CASE WHEN place = 2 THEN '' ELSE tokens[2] END || ' ' || CASE WHEN place = 3 THEN '' ELSE tokens[3] END
    || CASE WHEN place > 0 THEN ' ' || tokens[4] ELSE '' END AS leaf FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS place FROM distinct_lines) WHERE place = 0 OR n > 3),
sizes AS (SELECT leaf, sum(docs) AS all_docs, count(*) AS c FROM all_paths GROUP BY leaf),
own AS (SELECT line, all_docs AS own FROM all_paths JOIN sizes USING (leaf) WHERE place = 4),
paths AS (SELECT a.* FROM all_paths a JOIN sizes USING (leaf) LEFT JOIN own USING (line) WHERE c > 1 AND place < 4 AND (place = 0 OR own < greatest(2, 0.1 * all_docs))),
shared AS (SELECT leaf, sum(docs) AS leaf_docs FROM paths GROUP BY leaf HAVING count(*) > 1),
exploded AS (SELECT line, leaf, place, n, docs, leaf_docs, first, t.token, t.p FROM paths JOIN shared USING (leaf), LATERAL (SELECT unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p) t WHERE t.p <> place),
fixed AS (SELECT leaf, p, token FROM exploded GROUP BY leaf, p, token HAVING p <= 3 OR (p = 4 AND max(place) > 0) OR sum(docs) >= 2 AND sum(docs) >= 0.1 * any_value(leaf_docs)),
template AS (SELECT line, leaf, any_value(n) AS n, any_value(docs) AS docs, any_value(first) AS first, count(*) AS k, string_agg(p::VARCHAR || ':' || token, ' ' ORDER BY p) AS x
    FROM exploded JOIN fixed USING (leaf, p, token) GROUP BY line, leaf),
usable AS (SELECT * FROM template WHERE k >= 3 AND k >= 0.7 * n),
recur AS (SELECT leaf, x, min(first) AS keeper FROM usable GROUP BY leaf, x HAVING sum(docs) >= 2),
gone AS (SELECT line, min(first) AS first FROM (SELECT line, first FROM distinct_lines WHERE docs >= 2
    UNION ALL SELECT line, keeper FROM usable JOIN recur USING (leaf, x)) GROUP BY line),
numbered AS (SELECT d.doc_id, d.text, l.raw, l.i FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS raw, generate_subscripts(string_split(d.text, chr(10)), 1) AS i) l),
marked AS (SELECT doc_id, raw, i, regexp_replace(trim(regexp_replace(translate(raw, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' {2,}', ' ', 'g'), ' '), '[^ ]*(?:[0-9@]|://)[^ ]*', '<*>', 'g') AS line FROM numbered),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone.line IS NOT NULL AND gone.first <> doc_id) AS n_dropped,
    coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (gone.line IS NULL OR gone.first = doc_id), '') AS text FROM marked LEFT JOIN gone USING (line) GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, length(text)::BIGINT AS n_chars, sha256(text) AS text_sha256 FROM kept
"""
