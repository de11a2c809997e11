import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from folioworks import llm
from folioworks.llm import language, neardup
from tests.llm.test_operators import LOWER, WORD, groups

TOKEN = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def keeps_language(rows, model):
    """The ids that the classifier's matrix, text by text, gives a language with 0.35 or more."""
    _, matrix = model
    kept = set()
    for doc, text in rows:
        seen = np.zeros(language.PLACES, bool)
        if text and language.presence(text, seen):
            f = matrix[seen].sum(0) / np.sqrt(seen.sum())
            p = np.exp(3 * (f - f.max()))
            if p.max() / p.sum() >= 0.35:
                kept.add(doc)
    return kept


def shortened(path):
    """id -> (lines, lines dropped, characters left, hash of the text left) by the SQL of the line operator, over any documents."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return {r[0]: r[1:] for r in con.sql(llm.ORACLE_SQL["op10_lines"]).fetchall()}


def grams(text):
    w = TOKEN.findall((text or "").translate(LOWER))
    return w, lambda k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def leaking(rows, items):
    """The ids of documents that hold 0.8 of an item's shingles."""
    wanted = []
    for text in items:
        w, of = grams(text)
        if w:
            wanted.append((min(5, len(w)), of(min(5, len(w)))))
    out = set()
    for doc, text in rows:
        w, of = grams(text)
        own = {k: of(k) for k in {k for k, _ in wanted}}
        if any(len(g & own[k]) >= 0.8 * len(g) for k, g in wanted):
            out.add(doc)
    return out


def mixed(path):
    """id -> taken of what the mix takes, by the SQL of the mixing operator."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return {r[0]: r[4] for r in con.sql(llm.ORACLE_SQL["op7_mixing"]).fetchall() if r[6] > 0}


def test_each_stage_by_brute_force(spark, sf, tmp_path):
    """Every stage's rows against a plain computation over the stage's own input."""
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(9000, None, "en", "src1", 0), (9001, "", "en", None, 0), (9002, "12 34 !!", "de", "src1", 8)]
    item = duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet' WHERE length(text) > 40 ORDER BY item_id LIMIT 1").fetchall()[0][0]
    odd += [(9003, "Some words of my own come first. " + item + " Then a few more follow here.", "en", "src2", 9)]
    docs = documents.unionByName(spark.createDataFrame(odd, documents.schema))
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    docs.write.parquet(str(tmp_path / "documents"))
    docs, before = spark.read.parquet(str(tmp_path / "documents")), str(tmp_path / "documents")
    for name, stage in corpus_pipeline.STAGES:
        at = str(tmp_path / name)
        model = language.train(docs) if name == "language_id" else None
        stage(spark, docs, sf).write.parquet(at)
        rows, out = [(r.doc_id, r.text) for r in docs.collect()], spark.read.parquet(at)
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == out.count()
        if name == "language_id":
            assert set(got) == keeps_language(rows, model) and not set(got) & {9000, 9001, 9002}
        elif name == "line_dedup":
            want, sha = shortened(before), lambda t: hashlib.sha256(t.encode()).hexdigest()
            assert all(sha(r.text) == want[d][3] for d, r in got.items())
            assert all(want[d][1] == 0 or WORD.findall(r.text) for d, r in got.items())
            for d, t in rows:  # what goes has lost lines, and only lines without words are left
                assert d in got or want[d][1] > 0 and sha("\n".join(x for x in t.split("\n") if not WORD.findall(x))) == want[d][3]
        elif name == "near_dedup":
            assert set(got) == set(groups(rows, neardup.FIVE_WORDS.k, neardup.FIVE_WORDS.percent)[1].values())
        elif name == "decontamination":
            bad = leaking(rows, items)
            assert 9003 in bad and set(got) == {d for d, _ in rows} - bad
        else:
            assert {d: r.taken for d, r in got.items()} == pytest.approx(mixed(before))
        docs, before = out, at


def test_stages_work_on_what_the_one_before_kept(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            label = groups(rows, neardup.FIVE_WORDS.k, neardup.FIVE_WORDS.percent)[1]
            assert {r.doc_id for r in docs.collect()} == set(label.values())
    assert all(a >= b > 0 for a, b in zip(seen, seen[1:])) and seen[4] < seen[0]
    whole = collections.Counter((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, sf).collect())
    assert whole == collections.Counter((r.doc_id, r.taken) for r in docs.collect())


def test_stages_on_awkward_rows(spark, sf, corpus, nothing):
    for _, stage in corpus_pipeline.STAGES:
        for docs in (corpus, nothing):
            out = stage(spark, docs, sf)
            assert out.count() <= docs.count() and set(corpus.columns) - {"size"} <= set(out.columns)


def test_clean_documents_stay(spark, sf):
    rnd = random.Random(1)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    vocab = ["the", "and", "of", "that", "river", "stone", "window", "garden", "letter", "winter", "silver", "morning"]
    text = lambda: "\n".join(" ".join(rnd.choice(vocab) for _ in range(40)) for _ in range(3))
    clean = [(10_000 + i, text(), "en", "src1", 0) for i in range(30)]
    got = docs.unionByName(spark.createDataFrame(clean, docs.schema))
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, got, sf)
    assert got.where("doc_id >= 10000").count() == 30
