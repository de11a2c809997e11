"""Operator 7: mixing sources to target weights by hash-threshold histograms.

DataFrame functions only. Tables of one row for each source are broadcast up to a checked
number of rows, so a hot source's documents stay where they are. Every document has a hash of its key. Tokens are summed by
source and hash bucket; in each source the bucket where the running sum crosses the
budget is found, and only that bucket is summed again in finer buckets. What lies below
the threshold is taken, so no source is sorted and nothing but sums is shuffled.

Edge cases: a null text has size 0 and adds nothing; a null source is a source of its own,
last in order; an empty table gives an empty result; repeated rows and rows with one id (or
none) have one hash and are taken or left together, each by its own size; sources tied for a
level are filled in order of their names; a document of size 0 has taken 0; very long texts
are counted whole and are taken only if what is left holds them; columns of other names play
no part, and those named size, copies or taken are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, bounded, cut, documents, unused

BITS, LEVELS, ROUNDS = 12, 3, 3


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    trimmed = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    return F.coalesce(F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, f"{SPACE}+"))), F.lit(0)).cast("long")


def targets(sums: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Targets share ``share`` of all sizes by weight; none exceeds ``most`` times its source's
    size, what exceeds it is dealt again. In order of cap/weight the capped sources come
    first, so running sums give the level at which the rest is filled.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("all", F.sum("source_size").over(Window.partitionBy()) * share)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    # the level if this source and all after it are below their caps
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    fits = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    found = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(Window.partitionBy())
    return fits.withColumn("found", found["level"]).select("source", "source_size", F.least("cap", F.coalesce(F.col("found") * F.col("w"), F.col("cap"))).alias("target"))


def bucket(level: int) -> Column:
    """Bucket of the hash ``h`` at a level: its next BITS bits from the top."""
    return prefix(level).bitwiseAND(F.lit((1 << BITS) - 1))


def prefix(level: int) -> Column:
    """The leading bits of ``h`` up to and with a level."""
    return F.shiftright("h", BITS * (LEVELS - level - 1))


def threshold(sized: DataFrame, budgets: DataFrame, near: Column, level_one: DataFrame | None = None) -> DataFrame:
    """(source, left, edge, edge_n): in each source, the bucket of leading bits where the running sum of sizes crosses ``left``.

    Histograms of 2^BITS buckets, LEVELS times; each but the first sums only the boundary
    bucket of the one before. edge_n is what the last bucket holds, left what of the budget
    remains before it. Sources whose rows all fit have no row. ``near`` chooses rows of sized
    joined to the budgets.
    """
    edge = cut(budgets.select(F.col("source").alias("s"), "left", F.lit(0).cast("long").alias("edge"), F.col("left").alias("budget")))
    for level in range(LEVELS):
        if level_one is not None and level == 0:
            hist = level_one.withColumnRenamed("source", "t")
        else:
            within = F.lit(True) if level == 0 else prefix(level - 1) == F.col("edge")
            rows = sized.join(bounded(edge), F.col("source").eqNullSafe(F.col("s")) & within).where(near)
            hist = rows.groupBy(F.col("source").alias("t"), bucket(level).alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("t").orderBy("bucket")
        cum = hist.withColumn("upto", F.sum("n").over(run)).withColumn("below", F.col("upto") - F.col("n"))
        hit = edge.join(cum, F.col("s").eqNullSafe(F.col("t")) & (F.col("upto") > F.col("left")) & (F.col("below") <= F.col("left")))
        edge = cut(hit.select("s", (F.col("left") - F.col("below")).alias("left"), (F.col("edge") * (1 << BITS) + F.col("bucket")).alias("edge"), F.col("n").alias("edge_n"), "budget"))
    return edge.withColumnRenamed("s", "source")


def planned(sized: DataFrame, weights: list[int], share: float, most: float) -> tuple[DataFrame, Column]:
    """One row per source (of, source_size, target, thresholds), and the copies that a row of sized joined to it is taken.

    copies is how often a whole document is taken: the target divided by the source's size
    and rounded down, and one more where the hash is below the source's threshold. The
    document at the threshold may be large against what is left; so in two more rounds what
    is left goes, by a threshold again, to documents that fit it. In the last round the
    boundary bucket is taken where that comes nearer to the target.
    """
    first = cut(sized.groupBy("source", bucket(0).alias("bucket")).agg(F.sum("size").alias("n")))
    plan = targets(first.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("left0", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    free, extra = F.lit(True), F.lit(0)
    for r in range(ROUNDS):
        budgets = plan.select("source", F.col(f"left{r}").alias("left")).where("left > 0")
        before = [c for c in plan.columns if c.startswith(("left", "limit"))] if r else []
        rows = sized
        if r:
            state = bounded(plan.select(F.col("source").alias("of"), *before))
            rows = sized.join(state, F.col("source").eqNullSafe(F.col("of"))).where(free & (F.col("size") <= F.col(f"left{r}"))).select(*sized.columns)
        edge = threshold(rows, budgets, F.lit(True), first if r == 0 else None)
        nearer = F.col("left") * 2 > F.col("edge_n") if r == ROUNDS - 1 else F.lit(False)
        edge = edge.select(F.col("source").alias("of"), (F.col("edge") + nearer.cast("long")).alias(f"limit{r}"), F.col("left").alias(f"left{r + 1}"))
        # no row: nothing is left to deal, or all that fits is taken
        plan = plan.join(edge, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        all_fit = F.when(F.col(f"left{r}") > 0, F.lit(1 << (BITS * LEVELS))).otherwise(0)
        plan = cut(plan.withColumns({f"limit{r}": F.coalesce(f"limit{r}", all_fit).cast("long"), f"left{r + 1}": F.coalesce(f"left{r + 1}", F.lit(0.0))}))
        took = free & (prefix(LEVELS - 1) < F.col(f"limit{r}")) & (F.col("size") <= F.col(f"left{r}"))
        extra, free = extra + took.cast("long"), free & ~took
    return plan.withColumnRenamed("source", "of"), F.least(F.col("whole") + extra, F.lit(int(most)).cast("long"))


def sized_rows(docs: DataFrame, key: str) -> tuple[Column, Column]:
    """(size, h): words of the text, and the hash that decides: BITS * LEVELS bits, which any engine has."""
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":mix"))), 1, BITS * LEVELS // 4)
    return word_count(F.col("text")), F.conv(digits, 16, 10).cast("long")


def mix(docs: DataFrame, weights: list[int] = [1, 2, 3], share: float = 1.0, most: float = 3.0, key: str = "doc_id") -> DataFrame:  # noqa: B006
    """docs' (key, source, size, source_size, target, copies, taken)."""
    size, h = sized_rows(docs, key)
    sized = cut(docs.select(F.col(key), F.col("source"), size.alias("size"), h.alias("h")))
    plan, copies = planned(sized, weights, share, most)
    out = sized.join(bounded(plan), F.col("source").eqNullSafe(F.col("of")))
    out = out.select(key, "source", "size", "source_size", "target", copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixture(docs: DataFrame, weights: list[int] = [1, 2, 3], share: float = 1.0, most: float = 3.0, key: str = "doc_id") -> DataFrame:  # noqa: B006
    """The rows of docs that the mix takes, with size, copies and taken (which replace columns of these names).

    Whole rows are not shuffled: each row's size and hash are computed again beside the
    thresholds of its source. Rows that share an id are decided each by its own size.
    """
    size, h = sized_rows(docs, key)
    sized = cut(docs.select(F.col("source"), size.alias("size"), h.alias("h")))
    plan, copies = planned(sized, weights, share, most)
    # an explode of one struct keeps words from being counted once for each use
    rest, counted, names = docs.drop("size", "copies", "taken"), unused("counted", docs), {c: unused(c, docs) for c in plan.columns}
    own = rest.withColumn(counted, F.explode(F.array(F.struct(size.alias("size"), h.alias("h")))))
    own = own.join(bounded(plan.withColumnsRenamed(names)), F.col("source").eqNullSafe(F.col(names["of"])))
    whole = F.struct(*(F.col(f"`{c}`") for c in rest.columns)).alias("row")
    own = own.select(whole, F.col(f"{counted}.size"), F.col(f"{counted}.h"), *(F.col(names[c]).alias(c) for c in plan.columns))
    out = own.select("row.*", "size", copies.alias("copies")).where("copies > 0")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def _rounds_sql() -> str:
    """The rounds of the mix over single hashes: a threshold by nested histograms is the one that a running sum crosses."""
    steps, free, extra = [], "true", "0"
    for r in range(ROUNDS):
        of = f"plan{r}"
        rows = f"SELECT d.source, d.h, sum(d.size) AS n FROM sized d JOIN {of} p ON d.source IS NOT DISTINCT FROM p.source WHERE p.left{r} > 0 AND {free} AND {'true' if r == 0 else f'd.size <= p.left{r}'} GROUP BY d.source, d.h"
        run = f"SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM ({rows})"
        nearer = f" + (2 * (p.left{r} - (c.upto - c.n)) > c.n)::INT" if r == ROUNDS - 1 else ""
        steps.append(f"""plan{r + 1} AS (SELECT p.*, CASE WHEN c.h IS NOT NULL THEN c.h{nearer} WHEN p.left{r} > 0 THEN {1 << BITS * LEVELS} ELSE 0 END AS limit{r},
    CASE WHEN c.h IS NOT NULL THEN p.left{r} - (c.upto - c.n) ELSE 0 END AS left{r + 1} FROM {of} p LEFT JOIN ({run}) c ON c.source IS NOT DISTINCT FROM p.source AND c.upto > p.left{r} AND c.upto - c.n <= p.left{r} AND p.left{r} > 0)""")
        took = f"({free} AND d.h < p.limit{r} AND d.size <= p.left{r})"
        free, extra = f"({free} AND NOT {took})", f"{extra} + {took}::INT"
    return ",\n".join(steps) + f"""
SELECT doc_id, size, p.source_size, p.target, least(p.whole + {extra}, 3)::BIGINT * size AS taken, d.source, least(p.whole + {extra}, 3)::BIGINT AS copies
FROM sized d JOIN plan{ROUNDS} p ON d.source IS NOT DISTINCT FROM p.source"""


OP7_SQL = rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, {BITS * LEVELS // 4}))::BIGINT AS h FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM sums),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
found AS (SELECT *, (SELECT level FROM levels WHERE level * w <= cap ORDER BY cap / w, level LIMIT 1) AS fill FROM levels),
aimed AS (SELECT source, source_size, least(cap, coalesce(fill * w, cap)) AS target FROM found),
wholes AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM aimed),
plan0 AS (SELECT *, greatest(0.0, target - whole * source_size) AS left0 FROM wholes),
{_rounds_sql()}
"""
