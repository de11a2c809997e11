"""Views of the sample tables in the shapes the operators take, each with its SQL twin."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import decode
from ..sources import model as files
from .session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 vectors make a tile of 64 x 64 gray pixels (the last one is lower)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 1) * 127.5))).cast("int")
    return e.select(F.expr("vec_id div 64").alias("image_id"), (F.col("vec_id") % 64).cast("int").alias("y"), F.col("x").cast("int").alias("x"), level.alias("v"))


PIXELS = """pixels AS (SELECT vec_id // 64 AS image_id, (vec_id % 64)::INT AS y, (i - 1)::INT AS x,
    least(255, greatest(0, floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5)))::INT AS v FROM embeddings, range(1, 65) AS r(i))"""


def ink(level: int) -> str:
    return f"ink AS (SELECT image_id, y, x, (v <= {level})::INT AS v FROM pixels)"


SIZES = "sizes AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY image_id)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    x0, y0 = F.col("l_partkey") * 7 % 1000, F.col("l_orderkey") * 3 % 1400
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity").cast("long")).alias("x1"), (y0 + F.col("l_linenumber") * 5).alias("y1"))


BOXES = """boxes AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_partkey * 7 % 1000 AS x0, l_orderkey * 3 % 1400 AS y0,
    l_partkey * 7 % 1000 + floor(l_quantity)::BIGINT AS x1, l_orderkey * 3 % 1400 + l_linenumber * 5 AS y1 FROM lineitem)"""


def query_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = F.col("s_suppkey") * 37 % 1000, F.col("s_suppkey") * 53 % 1400
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("q"), x0.alias("x0"), y0.alias("y0"), (x0 + 60).alias("x1"), (y0 + 40).alias("y1"))


QUERY_BOXES = """query_boxes AS (SELECT s_suppkey AS q, s_suppkey * 37 % 1000 AS x0, s_suppkey * 53 % 1400 AS y0,
    s_suppkey * 37 % 1000 + 60 AS x1, s_suppkey * 53 % 1400 + 40 AS y1 FROM supplier)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's vectors among 200 neighbours are the timesteps of a line, so lines are short and their number grows.

    64 codes, 63 is blank, 0 the space.
    """
    line = (F.expr("vec_id div 200") * 1000 + F.col("label")).cast("long").alias("line_id")
    rows = table(spark, sf_dir, "embeddings").select(line, "vec_id", "embedding")
    t = (F.row_number().over(Window.partitionBy("line_id").orderBy("vec_id")) - 1).cast("int")
    return rows.select("line_id", t.alias("t"), "embedding")


LOGITS = "logits AS (SELECT line_id, (row_number() OVER (PARTITION BY line_id ORDER BY vec_id) - 1)::INT AS t, embedding FROM (SELECT (vec_id // 200 * 1000 + label)::BIGINT AS line_id, vec_id, embedding FROM embeddings))"


def probs64(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits(spark, sf_dir)
    return rows.select("line_id", "t", decode.softmax(F.transform("embedding", lambda v: v.cast("double") * 20)).alias("features"))


def probs8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of each 8 scores: 8 codes, 7 is blank, 0 the space."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.array_max(F.slice("embedding", b * 8 + 1, 8)))
    rows = logits(spark, sf_dir).select("line_id", "t", blocks.alias("m"))
    return rows.select("line_id", "t", decode.softmax(F.transform("m", lambda v: v.cast("double") * 20)).alias("features"))


#: score(line_id, t, code, p): probabilities by code for 64 and for 8 codes.
PROBS64 = f"""{LOGITS}, raw AS (SELECT line_id, t, (i - 1)::INT AS code, CAST(embedding[i] AS DOUBLE) * 20 AS s FROM logits, range(1, 65) AS r(i)),
    expd AS (SELECT line_id, t, code, exp(greatest(-86.0, s - max(s) OVER (PARTITION BY line_id, t))) AS e, s FROM raw),
    score AS (SELECT line_id, t, code, e / sum(e) OVER (PARTITION BY line_id, t) AS p, s FROM expd)"""
PROBS8 = f"""{LOGITS}, raw AS (SELECT line_id, t, (b - 1)::INT AS code, CAST(list_max(embedding[(b - 1) * 8 + 1 : b * 8]) AS DOUBLE) * 20 AS s FROM logits, range(1, 9) AS r(b)),
    expd AS (SELECT line_id, t, code, exp(greatest(-86.0, s - max(s) OVER (PARTITION BY line_id, t))) AS e, s FROM raw),
    score AS (SELECT line_id, t, code, e / sum(e) OVER (PARTITION BY line_id, t) AS p, s FROM expd)"""
BEST = "best AS (SELECT line_id, t, code, p FROM (SELECT *, row_number() OVER (PARTITION BY line_id, t ORDER BY s DESC, code) AS r FROM score) WHERE r = 1)"
RUNS = """turns AS (SELECT *, coalesce((lag(code) OVER w <> code)::INT, 1) AS turn, coalesce(lead(code) OVER w <> code, true) AS closes FROM best WINDOW w AS (PARTITION BY line_id ORDER BY t)),
    numbered AS (SELECT *, sum(turn) OVER (PARTITION BY line_id ORDER BY t) AS run FROM turns)"""


def greedy_sql(blank: int) -> str:
    return f"""{BEST}, {RUNS}, symbols AS (SELECT line_id, (row_number() OVER (PARTITION BY line_id ORDER BY min(t)) - 1)::INT AS idx, code, min(t)::INT AS start, (max(t) + 1)::INT AS "end"
        FROM numbered WHERE code <> {blank} GROUP BY line_id, run, code)"""


def scored_sql(blank: int) -> str:
    return f"""{greedy_sql(blank)},
    ends AS (SELECT *, (closes AND code <> {blank})::INT AS e FROM turns),
    led AS (SELECT line_id, least(sum(e) OVER (PARTITION BY line_id ORDER BY t) - e, sum(e) OVER (PARTITION BY line_id) - 1)::INT AS idx,
        (CASE WHEN p > exp(-20) THEN ln(p) ELSE -20 END) - 0.085 AS c FROM ends),
    sums AS (SELECT line_id, idx, least(0.0, min(c)) AS certainty, -sum(c) AS rating FROM led WHERE idx >= 0 GROUP BY line_id, idx),
    scored AS (SELECT s.*, sums.certainty, sums.rating FROM symbols s JOIN sums USING (line_id, idx)),
    widths AS (SELECT line_id, max(t) + 1 AS width FROM logits GROUP BY line_id)"""


#: Texts of the 8 codes (the blank has none).
TEXTS8 = " abcdef"


def chars8(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TEXTS8)), "code int, text string")


def charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct characters of the documents by code point; ids from 3 (0 space, 1 joined, 2 broken)."""
    each = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("text")).where("text <> ''").distinct()
    bits = sum(F.when(F.col("text").rlike(p), b).otherwise(0) for p, b in ((r"\p{L}", lexicon.ALPHA), (r"\p{Ll}", lexicon.LOWER), (r"\p{Lu}", lexicon.UPPER), (r"\p{Nd}", lexicon.DIGIT), (r"\p{P}", lexicon.PUNCTUATION)))
    # a few hundred characters at any size of the documents
    number = F.row_number().over(Window.orderBy("text")) + 2
    script = F.when(F.col("text").rlike(r"\p{L}"), "Latin").otherwise("Common")
    return each.select(number.cast("int").alias("id"), "text", F.col("text").alias("normed"), script.alias("script"), bits.cast("int").alias("properties"))


CHARSET = r"""chars AS (SELECT DISTINCT unnest(string_split(text, '')) AS text FROM documents),
    charset AS (SELECT (row_number() OVER (ORDER BY text) + 2)::INT AS id, text, CASE WHEN regexp_matches(text, '\p{L}') THEN 'Latin' ELSE 'Common' END AS script,
    (CASE WHEN regexp_matches(text, '\p{L}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '\p{Ll}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '\p{Lu}') THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '\p{Nd}') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(text, '\p{P}') THEN 16 ELSE 0 END)::INT AS properties FROM chars WHERE text <> '')"""


def recoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code 0 for the space, then one for each character in order; joined and broken share the last."""
    ids = charset(spark, sf_dir).select("id")
    own = ids.select(F.col("id").alias("unichar_id"), F.array(F.col("id") - 2).alias("code"))
    last = ids.agg((F.coalesce(F.max("id"), F.lit(2)) - 1).alias("last"))
    return own.unionByName(last.select(F.lit(0).alias("unichar_id"), F.array(F.lit(0)).alias("code"))).unionByName(last.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("unichar_id"), F.array("last").alias("code")))


RECODER = f"""{CHARSET}, recoder AS (SELECT id AS unichar_id, id - 2 AS code FROM charset UNION ALL SELECT 0, 0
    UNION ALL SELECT unnest([1, 2]), (SELECT max(id) - 1 FROM charset))"""


def lexicon_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[ \n.,]+")).alias("word"))
    return words.where(F.col("word").rlike("^[A-Za-z]+$")).distinct()


LEXICON = r"lexicon AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(text, '[ \n.,]+')) AS word FROM benchmark) WHERE regexp_full_match(word, '[A-Za-z]+'))"


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of ASCII letters of the documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", r"[ \n.,]+"))).alias("word"))
    return words.where(F.col("word").rlike("^[A-Za-z]+$")).distinct()


def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct runs of digits of the documents."""
    return table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), 0))).alias("word")).distinct()


WORDS = r"words AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(text, '[ \n.,]+')) AS word FROM documents) WHERE regexp_full_match(word, '[A-Za-z]+'))"
EDGES = f"""{LEXICON}, positions AS (SELECT word, unnest(range(1, length(word) + 1)) AS n FROM lexicon),
    edges AS (SELECT substring(word, 1, n - 1) AS node, substring(word, n, 1) AS letter, bool_or(n = length(word)) AS eow FROM positions GROUP BY ALL)"""


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns with their whole texts."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    want = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("want"))
    return c.select("conv_id", "turn", F.col("text").alias("got")).join(want, ["conv_id", "turn"])


#: DuckDB's levenshtein compares bytes, so the table's few other letters become control characters, one to one (26 at most; none of tab, line feeds and returns).
PAIRS = r"""wide AS (SELECT c, row_number() OVER (ORDER BY c) AS r, CASE WHEN r <= 8 THEN r ELSE r + 5 END AS k FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM conversations) WHERE c <> '' AND unicode(c) > 127),
    map AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS a, coalesce(string_agg(chr(k::INT), '' ORDER BY c), '') AS b FROM wide),
    c AS (SELECT conv_id, turn, translate(text, map.a, map.b) AS text FROM conversations, map),
    pairs AS (SELECT g.conv_id, g.turn, g.text AS got, w.text AS want FROM c g JOIN c w ON g.conv_id = w.conv_id AND w.turn = g.turn + 1)"""

#: The published topology of an English line model: (id, parent, position, type, name, inputs, outputs, weights, own weights).
ENGLISH = [
    (0, None, 0, "Series", "Series", 1, 111, 1461007, 0),
    (1, 0, 0, "Input", "Input", 1, 1, 0, 0),
    (2, 0, 1, "Series", "ConvNL", 1, 16, 160, 0),
    (3, 2, 0, "Convolve", "Convolve", 1, 9, 0, 0),
    (4, 2, 1, "Tanh", "ConvNL", 9, 16, 160, 160),
    (5, 0, 2, "Maxpool", "Maxpool", 16, 16, 0, 0),
    (6, 0, 3, "XYTranspose", "Lfys64", 16, 64, 20736, 0),
    (7, 6, 0, "SummLSTM", "Lfys64", 16, 64, 20736, 20736),
    (8, 0, 4, "LSTM", "Lfx96", 64, 96, 61824, 61824),
    (9, 0, 5, "RTLReversed", "Lrx96", 96, 96, 74112, 0),
    (10, 9, 0, "LSTM", "Lrx96", 96, 96, 74112, 74112),
    (11, 0, 6, "LSTM", "Lfx512", 96, 512, 1247232, 1247232),
    (12, 0, 7, "Softmax", "Output", 512, 111, 56943, 56943),
]


def layers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENGLISH, files.LAYER_SCHEMA)


LAYERS = "layers AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in ENGLISH) + ") AS v(layer_id, parent_id, ord, type, name, ni, no, num_weights, own_weights))"


#: The lexicon and the charset's size of the tiny model.
TINY_WORDS, TINY_SIZE = ("ab", "bad", "cab", "dead", "face", "feed"), 9


def tiny_model() -> files.Model:
    """A small network of every kind of layer on the recognition path, with seeded weights, and its lexicon."""
    rnd = np.random.RandomState(11)
    w = lambda rows, cols: np.round(rnd.uniform(-1, 1, (rows, cols)), 6)

    def layer(kind: str, name: str, ni: int, no: int, matrices=(), children=(), **more) -> files.LayerFile:
        out = files.LayerFile(kind, name, ni, no, 0, matrices=list(matrices), children=list(children), **more)
        out.num_weights = out.own_weights
        return out

    letters = TEXTS8[1:]
    lstm = lambda kind, name, ni, no: layer(kind, name, ni, no, [w(no, ni + no + 1) for _ in range(4)], na=ni + no)
    root = layer("Series", "Series", 1, 8, children=[
        layer("Input", "Input", 1, 1, shape=(1, 12, 0, 1, 0)),
        layer("Series", "ConvNL", 1, 4, children=[layer("Convolve", "Convolve", 1, 9, pair=(1, 1)), layer("Tanh", "ConvNL", 9, 4, [w(4, 10)])]),
        layer("Maxpool", "Maxpool", 4, 4, pair=(3, 3)),
        layer("XYTranspose", "Lfys6", 4, 6, children=[lstm("SummLSTM", "Lfys6", 4, 6)]),
        lstm("LSTM", "Lfx6", 6, 6),
        layer("RTLReversed", "Lrx6", 6, 6, children=[lstm("LSTM", "Lrx6", 6, 6)]),
        layer("Softmax", "Output", 6, 8, [w(8, 7) * 6]),
    ])
    chars = [files.Character(" ", " ", "Common", 0), files.Character("Joined", "Joined", "Common", 0), files.Character("|Broken|0|1", "Broken", "Common", 0)]
    chars += [files.Character(c, c, "Latin", lexicon.ALPHA | lexicon.LOWER) for c in letters]
    codes = [[0], [7], [7], *([i + 1] for i in range(len(letters)))]
    number = {c: i + 3 for i, c in enumerate(letters)}
    words = lexicon.build_edges([[number[c] for c in x] for x in TINY_WORDS])
    punc = lexicon.build_edges([[lexicon.WILDCARD]])
    graphs = {files.PUNC_GRAPH: (len(chars), lexicon.pack_edges(len(chars), punc)), files.WORD_GRAPH: (len(chars), lexicon.pack_edges(len(chars), words))}
    network = files.Network(root, "[1,12,0,1 Ct1,1,4 Mp3,3 Lfys6 Lfx6 Lrx6 O1c8]", files.COMPRESSED, 100, 100, 7, (0.999, 0.001, 0.5))
    return files.Model(network, chars, codes, graphs, "tiny:1")


def charset_text(m: files.Model) -> bytes:
    rows = [f"{'NULL' if c.text == ' ' else c.text} {c.properties:x} 0,255,0,255 {c.script}" + (f" 0 0 0 {c.normed}" if c.normed != c.text else "") for c in m.charset]
    return "\n".join([str(len(rows)), *rows]).encode() + b"\n"


def model_entries(m: files.Model, swap: bool = False) -> dict[int, bytes]:
    entries = {files.LSTM: files.build_network(m.network, swap), files.CHARSET: charset_text(m), files.RECODER: files.build_recoder(m.codes, swap), files.VERSION: m.version.encode() + b"\0"}
    for k, (size, records) in m.graphs.items():
        g = lexicon.unpack_edges(size, records)
        entries[k] = files.build_graph(size, list(zip(map(int, g.letters), map(int, g.following), map(bool, g.ends), map(bool, g.last))), swap)
    return entries


def model_bytes(m: files.Model, swap: bool = False) -> bytes:
    return files.build_container(model_entries(m, swap), swap)


#: The files of model_files: the same model in both byte orders.
MODEL_FILES = ("tiny.native", "tiny.swapped")


def model_files(spark: SparkSession) -> str:
    """A folder with the tiny model's files, written anew for the queries that read model files."""
    folder = f"{shared_folder(spark)}/folioworks-models/{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, swap in zip(MODEL_FILES, (False, True)):
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(model_bytes(tiny_model(), swap)))
        out.close()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(conf).deleteOnExit(at)
    return folder
