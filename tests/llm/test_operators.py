"""Each operator against brute force on small tables, and on awkward rows and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks import llm
from folioworks.llm import audio, common, decontaminate, hmm, language, licenses, lines, mixing, neardup, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def table(spark, texts, **more):
    return spark.createDataFrame([(i, t, more.get("lang", "en"), more.get("source", "s"), 0) for i, t in enumerate(texts)], DOCS)


def documents(sf):
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf}/documents.parquet'").fetchall()


# -- word hashing ------------------------------------------------------------


def test_word_spans_and_hashes():
    import pyarrow as pa

    texts = ["Ab ab\tAB", "", None, "  x ", "é\x0bÉ", "w" * 3000 + " ab"]
    data, off = common.utf8(pa.array(texts))
    s, e, first = common.word_spans(data, off)
    got = [bytes(data[a:b]).decode() for a, b in zip(s, e)]
    assert got == [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    h = common.word_hashes(data, s, e, block=64)
    low = [w.translate(LOWER) for w in got]
    assert all((h[i] == h[j]) == (low[i] == low[j]) for i in range(len(low)) for j in range(len(low)))
    assert np.array_equal(h, common.word_hashes(data, s, e))


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)]
    want = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


# -- 1: language model -------------------------------------------------------


def test_hmm_likelihood_by_enumeration():
    rnd = np.random.RandomState(0)
    norm = lambda a: (a / a.sum(-1, keepdims=True)).astype(np.float32)
    m = hmm.Model(norm(rnd.rand(3)), norm(rnd.rand(3, 3)), norm(rnd.rand(3, 5)).T.copy())
    seqs = [np.array(s) for s in ([1], [0, 4, 2], [3, 3, 3, 1], [2, 0])]
    from itertools import product

    for seq, got in zip(seqs, hmm.Packed(seqs).loglik(m)):
        total = 0.0
        for path in product(range(3), repeat=len(seq)):
            p = m.start[path[0]] * m.emit[seq[0], path[0]]
            for t in range(1, len(seq)):
                p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
            total += p
        assert got == pytest.approx(math.log(total), abs=1e-5)


def test_baum_welch_never_loses():
    rnd = np.random.RandomState(1)
    seqs = [rnd.randint(0, 6, rnd.randint(1, 30)) for _ in range(40)]
    uni = np.full(6, 1 / 6)
    m, last = hmm.initial(seqs, uni, 3, 0), -np.inf
    for _ in range(6):
        start, moves, emits, like = hmm.Packed(seqs).expect(m)
        assert like >= last - 1e-3
        assert start.sum() == pytest.approx(len(seqs), rel=1e-4) and emits.sum() == pytest.approx(sum(map(len, seqs)), rel=1e-4)
        m, last = hmm.maximise(start, moves, emits, uni, prior=0.0), like


def test_lm_score_by_brute_force(spark, sf):
    docs = documents(sf)
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in docs}
    count, ends = collections.Counter(), 0
    for d, t, *_ in docs:
        if not held[d]:
            count.update(words(t))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    got = {r.doc_id: r for r in llm.QUERIES["op1_lm_score"](spark, sf).collect()}
    for d, t, *_ in docs:
        w, r = words(t), got[d]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w) + 1, sum(x in count for x in w) + 1, n)
        assert r.base_score == pytest.approx(base, abs=1e-6)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


# -- 2: personal data --------------------------------------------------------

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(BASE):
        for m in re.finditer(p, text):
            digits = re.sub(r"\D", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            out += [(m.start(), k, m.end())] * ok
    return [(BASE[k][0], s, e) for s, k, e in sorted(out)]


def test_pii_base_spans_on_random_text():
    rnd = random.Random(4)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (974) 555-3436", "+", "-", " ", "x", "9", "..", "@@", "b@c", "b@c.d.", "00012", "é", "123.45.67.89.10", "+49 30 123456789", "%"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9)))
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == base_spans(text), text


def test_pii_added_spans():
    kinds = lambda t: [(k, t[s:e]) for k, s, e in pii.find(t)]
    assert kinds('x token = "99168226c4d3" y') == [("account", "99168226c4d3")]
    assert kinds("see https://a.example.com/p?q=1, now") == [("url", "https://a.example.com/p?q=1")]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00.") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN: DE88 3704 0044 0532 0130 00.") == [] and kinds("token of love") == [] and kinds("http://nodots") == []
    assert kinds("account no: 4111 1111 1111 1111")[0][0] == "card" and pii.find(None) == pii.find("") == []


def test_pii_long_schemes_and_many_addresses():
    kinds = lambda t: [(k, t[s:e]) for k, s, e in pii.find(t)]
    long = "averyveryverylongscheme" * 3
    assert kinds(f"see {long}://a.example.com!") == [("url", f"{long}://a.example.com")]
    assert kinds("12https://a.example.com/http://b.example.com") == [("url", "https://a.example.com/http://b.example.com")]
    assert kinds("https://me@b.example.com/x https://c.example.com") == [("email", "me@b.example.com"), ("url", "https://c.example.com")]
    import time

    took = []
    for n in (2000, 16_000):
        text = "mail a.b@c.de or https://x.example.com/p?q=1 now, token=ab12cd34 " * n
        began = time.time()
        assert len(pii.find(text)) == 3 * n
        took.append(time.time() - began)
    assert took[1] < 30 * max(0.02, took[0])


def test_pii_cues_in_any_case():
    kinds = lambda t: [(k, t[s:e]) for k, s, e in pii.find(t)]
    for cue in ("User ID: ", "Customer ID: ", "Member ID: ", "Tax ID: ", "API key: ", "API_Key=", "apiKey = ", "pAsSwOrD: ", "\u0130\u0130 User ID: ", "\u00c4\u212a User ID: "):
        assert kinds(f"my {cue}4471234, ok") == [("account", "4471234")], cue
    assert kinds("to\u212aen: 4471234") == []
    for c in range(0x110000):
        assert pii.folded(chr(c)) == (chr(c + 32) if 65 <= c <= 90 else chr(c)) or len(pii.folded(chr(c))) == 1 and not pii.folded(chr(c)).isascii()


def test_pii_rows(spark, corpus, nothing):
    docs = table(spark, ["mail a.b@c.de or +1 (974) 555-3436", None])
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {0: "mail [email] or [phone]", 1: None}
    assert pii.spans(corpus).count() == corpus.count() and pii.spans(nothing).count() == 0


def test_pii_query(spark, sf):
    got = {r.doc_id: r for r in llm.QUERIES["op2_pii"](spark, sf).collect()}
    for d, t, *_ in documents(sf):
        b = base_spans(t)
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()
        assert got[d].n_card == sum(k == "card" for k, _, _ in b)


# -- 3: decontamination ------------------------------------------------------


def test_wand_finds_all_above_the_threshold():
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    index = decontaminate.Index([(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 25)))) for i in range(90)])
    for _ in range(60):
        terms = sorted(rnd.sample(range(len(index.terms)), rnd.randint(1, 40)))
        score = collections.Counter()
        for t in terms:
            for at, w in index.postings[t]:
                score[at] += w
        for threshold in (0.1, 0.5, 0.7):
            want = {at for at, s in score.items() if s >= threshold}
            assert {at for at, _ in index.search(terms, threshold)} == want


def test_leaks_by_brute_force(spark, sf):
    token = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")

    def grams(t):
        w = token.findall(t.translate(LOWER))
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    items = {i: grams(t) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()}
    want = {(d, i) for d, t, *_ in documents(sf) for i, g in items.items() if len(g & grams(t)) >= 0.8 * len(g)}
    got = {(r.doc_id, r.item_id) for r in llm.QUERIES["op3_decontaminate"](spark, sf).collect()}
    assert got == want and want


def shingle_leaks(items, texts):
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    tok = lambda t: re.findall("[0-9a-z]+", t.lower())
    want = set()
    for d, t in enumerate(texts):
        for i, x in items:
            parts = []
            for part in (x, *decontaminate.question_answer(x)):
                w = tok(part)
                g = grams(w, min(5, len(w)))
                parts.append(len(g & grams(tok(t), min(5, len(w)))) / len(g) if g else 1.0)
            if parts[0] >= 0.8 or parts[1] >= 0.8 and parts[2] >= 0.8:
                want.add((d, i))
    return want


def test_items_of_one_template_are_found(spark, monkeypatch):
    """Items that differ in one rare word share nearly all shingles: a text with another word leaks all of them."""
    items = [(i, f"what is the exact boiling point of the element x{i}q") for i in range(400)]
    items += [(500 + i, f"Which city is the capital of the land n{i}? City c{i} is the capital of it.") for i in range(60)]
    items += [(600, "?! what is this thing called here now"), (601, "one two three four five six seven")]
    texts = ["so: what is the exact boiling point of the element unknown, really", "what is the exact boiling point of tea", "boiling point of the element x7q and no more", items[3][1].upper()]
    texts += ["filler " * 90 + "Which city is the capital of the land n3? City c9 is the capital of it. more", "pad " * 200 + items[17][1] + " pad" * 200, "what is this thing called here now", "", "x9q"]
    table_ = spark.createDataFrame(items, "item_id long, text string")
    want = shingle_leaks(items, texts)
    assert len([x for x in want if x[0] == 0]) == 400
    for shard in (decontaminate.SHARD, 50):
        monkeypatch.setattr(decontaminate, "SHARD", shard)
        got = decontaminate.leaks(table(spark, texts), table_)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_no_leak_is_lost_to_the_search(spark, monkeypatch):
    """Passages with just enough of an item's shingles, its rarest words missing; small shards, one pass or several."""
    rnd = random.Random(12)
    common_ = [f"c{i}" for i in range(25)]
    items = []
    for i in range(120):
        body = [rnd.choice(common_) if rnd.random() < 0.7 else f"rare{i}x{j}" for j in range(rnd.randint(4, 60))]
        body.insert(len(body) * 2 // 3, "end.")
        items.append((i, " ".join(body)))
    texts = []
    for d in range(240):
        i, t = items[d % 120]
        w, keep = t.split(), 0.78 + 0.1 * rnd.random()
        cut_ = round(len(w) * keep)
        at = rnd.choice((0, len(w) - cut_, rnd.randint(0, len(w) - cut_)))
        texts.append(" ".join([rnd.choice(common_) for _ in range(30)] + w[at : at + cut_] + [rnd.choice(common_) for _ in range(30)]))
    want = shingle_leaks(items, texts)
    table_ = spark.createDataFrame(items, "item_id long, text string")
    for shard, size in ((decontaminate.SHARD, decontaminate.INDEX_BYTES), (16, decontaminate.INDEX_BYTES), (16, 0)):
        monkeypatch.setattr(decontaminate, "SHARD", shard)
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, texts), table_).collect()}
        assert got == want and len(want) > 60


def test_leaks_on_awkward_rows(spark, corpus, nothing):
    items = spark.createDataFrame([(1, "What is the capital of the land of many rivers and hills? It is the old town of Esten."), (2, None), (3, ""), (None, "x y"), (4, "two words")], "item_id long, text string")
    text = "intro " * 300 + "what IS the capital of the land of many rivers, and hills? it is the old town of esten " + "outro " * 300
    docs = table(spark, [text, "nothing here", None, "the capital of the land", "two words"])
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(0, 1), (4, 4)}
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.leaks(nothing, items).count() == 0
    assert decontaminate.without_leaks(corpus, items).count() == corpus.count()


# -- 4: licenses -------------------------------------------------------------


def test_licenses(spark, corpus, nothing):
    files = [
        ("a/x.txt", "Some prose.\nReleased under the MIT License.\nMore prose."),
        ("a/b/y.txt", "plain prose"),
        ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/b/c/z.txt", "plain prose"),
        ("a/w.txt", None),
        ("v.txt", ""),
        (None, "Released under the MIT License."),
        ("q/COPYING", "All rights reserved."),
        ("q/r/s.txt", "words on the public license of things in general, which go on and on"),
    ]
    got = {r.path: (r.license, r.origin) for r in licenses.inherit(common.cut(licenses.scan(spark.createDataFrame(files, "path string, text string")))).collect()}
    assert got == {
        "a/x.txt": ("MIT", "header"), "a/b/y.txt": ("Apache-2.0", "directory"), "a/b/LICENSE": ("Apache-2.0", "header"), "a/b/c/z.txt": ("Apache-2.0", "directory"),
        "a/w.txt": (None, None), "v.txt": (None, None), None: ("MIT", "header"), "q/COPYING": ("Proprietary", "header"), "q/r/s.txt": ("Proprietary", "directory"),
    }
    scanned = licenses.scan(corpus.withColumn("path", F.concat(F.lit("p/"), F.col("doc_id").cast("string"))))
    assert licenses.inherit(common.cut(scanned)).count() == corpus.count()
    assert licenses.inherit(common.cut(licenses.scan(nothing.withColumn("path", F.col("source"))))).count() == 0


def test_license_pruning_loses_nothing():
    t = licenses.Templates(licenses.NOTICES, licenses.TEXTS, {}, 100, 0.6)
    rnd = random.Random(5)
    for whole, kind in ((False, licenses.NOTICES), (True, licenses.TEXTS)):
        hits = 0
        for _ in range(600):
            words_ = rnd.choice(kind)[1].split()
            part = rnd.sample(words_, rnd.randint(1, len(words_)))
            h = decontaminate.hashes_of(" ".join(part) + " noise words" * rnd.randint(0, 3))
            if t.cosine(h, whole)[0] >= 0.6:
                hits += 1
                at = t.lookup(h)
                assert t.essential[int(whole), at[at >= 0]].any()
        assert hits > 50


def test_license_files_and_wrapped_notices(spark):
    """Whole licence texts license their directory; a notice wrapped over comment lines is a header; prose is neither."""
    import textwrap

    wrap = lambda t, mark: "\n".join(mark + x for x in textwrap.wrap(t, 60))
    text, notice = dict(licenses.TEXTS), dict(licenses.NOTICES)
    files = [(f"{k}/LICENSE.txt", "Copyright (c) 2024 Some Body\n\n" + wrap(v, "")) for k, v in text.items()]
    files += [(f"{k}/src/code.c", "int main;") for k in text]
    files += [(f"n/{k}.c", wrap(notice[k], "// ") + "\nint main;") for k in ("Apache-2.0", "MPL-2.0", "GPL-2.0", "AGPL-3.0", "EPL-2.0", "ISC")]
    prose = "The work of the contributor was to copy the software, and the source of the river is in the hills of the licence office. " * 30
    files += [("prose/a.txt", prose), ("prose/b.txt", prose[:300])]
    got = {r.path: r for r in licenses.inherit(common.cut(licenses.scan(spark.createDataFrame(files, "path string, text string")))).collect()}
    for k in text:
        assert got[f"{k}/LICENSE.txt"].file_license == k
        assert (got[f"{k}/src/code.c"].license, got[f"{k}/src/code.c"].origin) == (k, "directory")
    assert all(got[p].own == p[2:-2] and got[p].header == 1 for p in got if p.startswith("n/"))
    assert got["prose/a.txt"].license is None and got["prose/b.txt"].license is None


def test_full_licence_texts_come_out_right_or_not_at_all(spark, sf):
    """Whole published texts in licence files among documents: versions are told apart, unknown ones take no notice in them for their own."""
    folder = Path("/usr/share/common-licenses")
    right = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}
    unknown = ["GPL-1", "LGPL-2", "GFDL-1.2", "GFDL-1.3", "MPL-1.1", "Artistic"]
    there = [k for k in [*right, *unknown] if (folder / k).exists()]
    if not there:
        pytest.skip("no licence texts on this machine")
    files = [(f"{k}/{name}", text) for k in there for name, text in (("LICENSE", (folder / k).read_text()), ("src/deep/a.c", "int main;"))]
    files += [(f"docs/{i}.txt", t) for i, t, *_ in documents(sf)]
    got = {r.path: (r.license, r.origin) for r in licenses.inherit(common.cut(licenses.scan(spark.createDataFrame(files, "path string, text string")))).where("path not like 'docs/%'").collect()}
    wrong = {k: got[f"{k}/LICENSE"] for k in there if got[f"{k}/LICENSE"][0] != right.get(k)}
    assert not wrong
    assert all(got[f"{k}/src/deep/a.c"] == ((right[k], "directory") if k in right else (None, None)) for k in there)


def test_licenses_by_brute_force(spark, sf):
    """The whole query with plain dictionaries: every line and file against every template, then the nearest ancestor."""
    token = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
    tokens = lambda t: [w.translate(LOWER) for w in token.findall(t or "")]
    docs = documents(sf)
    known = {w for _, t in [*licenses.NOTICES, *licenses.TEXTS] for w in tokens(t)}
    df = collections.Counter(w for _, t, *_ in docs for w in set(tokens(t)) & known)
    idf = lambda w: math.log((len(docs) + 1) / (df[w] + 1)) + 1

    def vector(t):
        v = {w: n * idf(w) for w, n in collections.Counter(tokens(t)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    notices, texts = ([(k, vector(t)) for k, t in x] for x in (licenses.NOTICES, licenses.TEXTS))

    def best(t, templates):
        v = vector(t)
        return min(((-round(sum(x * u.get(w, 0) for w, x in v.items()), 12), k) for k, u in templates), default=(0, None)) if v else (0, None)

    own, whole = {}, {}
    for d, t, lang, source in docs:
        path = f"{source}/{lang}/{d // 100}/{d}.txt"
        score, _, k = min(((*best(x, notices), i)[0], i, best(x, notices)[1]) for i, x in enumerate((t or "").split("\n")))
        lines = sorted((*best(x, notices), i) for i, x in enumerate((t or "").split("\n")))
        own[d] = (path, lines[0][1] if lines[0][0] <= -0.6 else None)
        score, k = best(t, texts)
        whole[d] = (score, k) if score <= -0.6 else None
    gives = {}
    for d, (path, _) in own.items():
        if whole[d]:
            folder = path.rpartition("/")[0]
            gives[folder] = min(gives.get(folder, (1, "")), whole[d])
    for r in llm.QUERIES["op4_licenses"](spark, sf).collect():
        path, mine = own[r.doc_id]
        up = path.split("/")[:-1]
        near = next((gives["/".join(up[:n])][1] for n in range(len(up), 0, -1) if "/".join(up[:n]) in gives), None)
        if r.own_score is None or r.own == mine:  # wrapped notices may add one, never take one away
            assert (r.path, r.own, r.license) == (path, mine, whole[r.doc_id][1] if whole[r.doc_id] else mine or near)
        else:
            assert mine is None


# -- 5: quality --------------------------------------------------------------


def test_posteriors_shrink(spark):
    rows = [(i, "good", "p", 3.0) for i in range(40)] + [(100 + i, "bad", "p", -3.0) for i in range(40)] + [(200, "bad", "q", 0.0), (201, "good", "q", 0.0), (202, None, None, 0.0)]
    got = {r.doc_id: r for r in quality.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, logit double")).collect()}
    assert len(got) == len(rows) and got[201].posterior > 0.5 > got[200].posterior
    assert got[0].host_rate > got[202].host_rate > got[100].host_rate


def test_quality_accuracy(spark, sf):
    """On labels the fit has not seen."""
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    rows = llm.QUERIES["op5_quality"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    got = [r for r in rows if r.doc_id in label and r.held_out]
    assert len(got) >= 10 and sum(r.kept == bool(label[r.doc_id]) for r in got) >= 0.85 * len(got)


def test_quality_by_brute_force(spark, sf):
    """Rates and posteriors from the evidence, by loops over sites."""
    rows = llm.QUERIES["op5_quality"](spark, sf).collect()
    lang = {d: (s, v) for d, _, v, s in documents(sf)}
    assert all(r.host == f"{lang[r.doc_id][0]}.{r.doc_id // 1000}" and r.path == lang[r.doc_id][1] for r in rows)
    e = {r.doc_id: r.evidence for r in rows}
    overall = (sum(e.values()) + 0.5) / (len(e) + 1)

    def grouped(key):
        out = collections.defaultdict(list)
        for r in rows:
            out[key(r)].append(e[r.doc_id])
        return {k: (len(v), sum(v)) for k, v in out.items()}

    def strength(sites, parent):
        n, n2 = sum(c for c, _ in sites.values()), sum(c * c for c, _ in sites.values())
        ss = sum(c * (s / c - parent(k)) ** 2 for k, (c, s) in sites.items())
        chance = sum(c * parent(k) * (1 - parent(k)) for k, (c, _) in sites.items()) / n
        between = (ss - (len(sites) - 1) * chance) / (n - n2 / n)
        return min(1e6, max(1.0, chance / between - 1)) if between > 0 else 1e6

    hosts, paths = grouped(lambda r: r.host), grouped(lambda r: (r.host, r.path))
    m = strength(hosts, lambda k: overall)
    host_rate = {k: (s + m * overall) / (c + m) for k, (c, s) in hosts.items()}
    k = strength(paths, lambda p: host_rate[p[0]])
    logit = lambda p: math.log(p / (1 - p))
    for r in rows:
        c, s = paths[r.host, r.path]
        h = host_rate[r.host]
        without = min(1 - 1e-6, max(1e-6, (s - e[r.doc_id] + k * h) / (c - 1 + k)))
        odds = logit(e[r.doc_id]) + logit(without) - logit(overall)
        assert r.host_rate == pytest.approx(h, rel=1e-6) and r.path_rate == pytest.approx((s + k * h) / (c + k), rel=1e-6)
        assert r.posterior == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-5)


def test_quality_on_awkward_rows(spark, corpus, nothing):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for docs in (corpus, nothing):
        for known in (labels, labels.limit(0)):
            out = quality.quality(docs, known, F.col("source"), F.col("lang"))
            assert out.count() == docs.count()
    assert quality.quality(corpus, labels.limit(0), F.col("source"), F.col("lang")).where("not kept").count() == 0


# -- 6: audio ----------------------------------------------------------------


def tone(rnd, rate, seconds):
    t = np.arange(int(rate * seconds)) / rate
    out = np.zeros(len(t))
    for i in range(int(seconds * 4)):
        part = slice(int(i * rate / 4), int((i + 1) * rate / 4))
        out[part] = np.sin(2 * np.pi * 440 * 2 ** (rnd.randint(0, 24) / 12) * t[part])
    return out


def test_recordings_align(spark):
    rnd, rate = np.random.RandomState(0), 8000
    a, b = tone(rnd, rate, 8), tone(rnd, rate, 8)
    noisy = a[5460:] + rnd.randn(len(a) - 5460) * 0.02  # begins four frames later
    rows = [(1, a.tolist()), (2, noisy.tolist()), (3, b.tolist()), (4, a.tolist()), (5, None), (6, [0.0] * 10), (None, a.tolist()), (4, a.tolist())]
    got = {r.rec: r for r in audio.recordings_aligned(spark.createDataFrame(rows, "rec long, x array<double>"), "rec", "x", rate).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 6)] == [1, 1, 3, 1, 5, 6] and got[4].class_id == 1 and got[2].links == 1 and got[None].component_id is None
    assert audio.recordings_aligned(spark.createDataFrame([], "rec long, x array<double>"), "rec", "x").count() == 0


def test_alignment_by_brute_force(spark):
    """All pairs and offsets that share an integer; groups above FEW go through the blocks."""
    rnd = np.random.RandomState(1)
    base = [rnd.randn(64) * 0.15 for _ in range(4)]
    rows = [(i, (base[i % 4] + rnd.randn(64) * (0.004 + 0.03 * rnd.rand())).tolist()) for i in range(160)]
    fp = {i: audio.fingerprint(audio.chroma_of_bins(np.array(x))) for i, x in rows}
    label = {i: i for i in fp}
    for i in fp:
        for j in range(i):
            for shift in {int(q - p) for p, q in zip(*np.nonzero(fp[i][:, None] == fp[j][None]))}:
                x, y = fp[i][max(0, -shift) : len(fp[i]) - max(0, shift)], fp[j][max(0, shift) : len(fp[j]) - max(0, -shift)]
                if len(x) >= 13 and np.bitwise_count(x ^ y).sum() <= 0.15 * 32 * len(x) and label[i] != label[j]:
                    a, b = sorted((label[i], label[j]))
                    label = {k: a if v == b else v for k, v in label.items()}
    got = {r.rec: r.component_id for r in audio.recordings_aligned(spark.createDataFrame(rows, "rec long, x array<double>"), "rec", "x").collect()}
    assert got == label


def test_alignment_of_all_pairs_and_offsets(spark, monkeypatch):
    """Noise leaves many aligned pairs no equal integer; every one is linked and counted, in one block or several."""
    rnd = np.random.RandomState(6)
    base = [rnd.randn(70) * 0.15 for _ in range(12)]
    rows = [(i, (base[i % 12][i % 5 : i % 5 + 64 - i % 3] + rnd.randn(64 - i % 3) * 0.03).tolist()) for i in range(72)]
    fp = {i: audio.fingerprint(audio.chroma_of_bins(np.array(x))) for i, x in rows}
    label, links, unequal = {i: i for i in fp}, collections.Counter(), 0
    for i in fp:
        for j in range(i):
            found = False
            for shift in range(1 - len(fp[i]), len(fp[j])):
                x, y = fp[i][max(0, -shift) :], fp[j][max(0, shift) :]
                n = min(len(x), len(y))
                found |= n >= 13 and np.bitwise_count(x[:n] ^ y[:n]).sum() <= 0.15 * 32 * n
            if found:
                links.update((i, j))
                unequal += not np.isin(fp[i], fp[j]).any()
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    assert unequal and max(links.values()) > 2
    for codes in (audio.BLOCK_CODES, 500):
        monkeypatch.setattr(audio, "BLOCK_CODES", codes)
        got = audio.recordings_aligned(spark.createDataFrame(rows, "rec long, x array<double>"), "rec", "x", every=True).collect()
        assert {r.rec: (r.component_id, r.links) for r in got} == {i: (label[i], links[i]) for i in fp}
    monkeypatch.undo()
    x = dict(rows)
    rows = [(1, x[0]), (2, x[12]), (2, x[12]), (3, x[0]), (4, None), (None, x[0])]
    got = {(r.rec, r.n_codes > 0): (r.class_id, r.component_id) for r in audio.recordings_aligned(spark.createDataFrame(rows, "rec long, x array<double>"), "rec", "x", every=True).collect()}
    assert got[3, True] == (1, 1) and got[4, False] == (4, 4) and got[None, True] == (None, None)
    assert audio.recordings_aligned(spark.createDataFrame([], "rec long, x array<double>"), "rec", "x", every=True).count() == 0


def searched(fp, queries, max_error=0.15, min_overlap=13, z=5.5):
    """All (query, other) that are aligned at any offset, by trying all."""
    out = set()
    for i in queries:
        for j in fp:
            for shift in range(1 - len(fp[i]), len(fp[j])):
                x, y = fp[i][max(0, -shift) :], fp[j][max(0, shift) :]
                n = min(len(x), len(y))
                least = min(max_error, audio.UNRELATED[0] - z * audio.UNRELATED[1] / math.sqrt(max(1, n)))
                if i != j and n >= min_overlap and np.bitwise_count(x[:n] ^ y[:n]).sum() <= least * 32 * n:
                    out.add((i, j))
    return out


def test_search_of_sampled_sound(spark):
    """Noisy cuts of melodies at any sample, as PCM: the search against all pairs at all offsets, and against what was cut."""
    rnd, rate = np.random.RandomState(17), 8000
    note = lambda: sum(np.sin(2 * np.pi * 110 * 2 ** (rnd.randint(0, 48) / 12) * np.arange(3200) / rate) for _ in range(2))
    base = [np.concatenate([note() for _ in range(60)]) for _ in range(6)]
    cut = {}
    for i in range(48):
        x, size = base[i % 6], rnd.randint(12, 16) * rate
        at = rnd.randint(0, len(x) - size)
        cut[i] = (at, size, (x[at : at + size] + rnd.randn(size) * 0.1).astype(float))
    df = spark.createDataFrame([(i, x.tolist()) for i, (_, _, x) in cut.items()], "rec long, x array<double>").repartition(8)
    pairs, _ = audio.alignments(df, "rec", "x", F.col("rec") % 4 == 0, rate=rate)
    got = {(r.a, r.b): r["shift"] for r in pairs.collect()}
    fp = {i: audio.fingerprint(audio.chroma_of_pcm(x, rate)) for i, (_, _, x) in cut.items()}
    want = searched(fp, [i for i in fp if i % 4 == 0])
    assert len(want) > 30 and set(got) <= want and len(got) >= 0.9 * len(want)
    assert all(a % 6 == b % 6 for a, b in got)
    assert all(abs(shift - (cut[a][0] - cut[b][0]) / 1365) <= 1 for (a, b), shift in got.items())


def test_search_finds_noisy_cuts(spark):
    """Cuts of longer signals at several offsets and noise levels, against all pairs at all offsets."""
    rnd = np.random.RandomState(11)
    base = [np.cumsum(rnd.randn(220)) * 0.05 + rnd.randn(220) * 0.15 for _ in range(12)]
    rows = []
    for i in range(150):
        x, at = base[i % 12], rnd.randint(0, 100)
        rows.append((i, x[at : at + rnd.randint(60, 120)].tolist()))
    rows = [(i, (np.array(x) + rnd.randn(len(x)) * 0.03 * rnd.rand()).tolist()) for i, x in rows]
    df = spark.createDataFrame([*rows, (150, rows[0][1]), (151, None), (152, []), (None, rows[0][1]), rows[3]], "rec long, x array<double>")
    pairs, members = audio.alignments(df, "rec", "x", F.col("rec") % 5 == 0)
    got = {(r.a, r.b): r for r in pairs.collect()}
    fp = {i: audio.fingerprint(audio.chroma_of_bins(np.array(x))) for i, x in rows}
    want = searched(fp, [i for i in fp if i % 5 == 0])
    assert len(want) > 50 and set(got) <= want and len(got) >= 0.9 * len(want)
    for (a, b), r in got.items():
        x, y = fp[a][max(0, -r["shift"]) :], fp[b][max(0, r["shift"]) :]
        n = min(len(x), len(y))
        assert r.overlap == n and r.error == pytest.approx(np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n)) and r.votes >= 2
    member = {r.id: r for r in members.collect()}
    assert member[150].class_id == 0 and member[0].rows == 2 and member[150].asked and member[151].n_codes <= 0 and None not in member


def test_search_query(spark, sf):
    rows = llm.QUERIES["op6_fingerprints"](spark, sf).collect()
    vectors = dict(duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall())
    fp = {i: audio.fingerprint(audio.chroma_of_bins(np.array(x, float))) for i, x in vectors.items()}
    want = searched(fp, [i for i in fp if i % 20 == 0])
    assert {r.vec_id for r in rows} == {i for i in fp if i % 20 == 0} and sum(r.links for r in rows) >= 0.9 * len(want)


def test_search_on_awkward_rows(spark):
    silence, tone_ = [0.0] * 64, [math.sin(i / 3) for i in range(64)]
    rows = [(0, silence), (20, silence), (1, tone_), (40, tone_ + [0.0] * 30), (60, None), (80, []), (100, [float("nan"), None] * 32), (None, tone_)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pairs, members = audio.alignments(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0)
    assert {r.id: r.class_id for r in members.collect()} == {0: 0, 20: 0, 1: 1, 40: 40, 60: 60, 80: 80, 100: 0}
    assert (40, 1) in {(r.a, r.b) for r in pairs.collect()}
    empty = audio.alignments(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0)
    assert empty[0].count() == 0 and empty[1].count() == 0
    with pytest.raises(TypeError):
        audio.alignments(df.withColumn("vec_id", F.col("vec_id").cast("string")), "vec_id", "embedding", F.lit(True))


def rows_of_joins(spark, run):
    """The most rows that a join makes in what run() executes, by Spark's own count."""
    store, bus, most = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus(), 0

    def executions():
        bus.waitUntilEmpty()
        done = store.executionsList()
        return {done.apply(i).executionId() for i in range(done.size())}

    before = executions()
    run()
    for i in executions() - before:
        nodes, values = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for node in (nodes.apply(j) for j in range(nodes.size())):
            metrics = [node.metrics().apply(k) for k in range(node.metrics().size())] if "Join" in node.name() else []
            counts = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
            most = max([most, *(int(v.get().replace(",", "")) for v in counts if v.isDefined())])
    return most


def test_search_of_near_copies(spark, tmp_path, monkeypatch):
    """A group of near copies: twice its size makes about twice the rows, not four times; all links are found and counted, in parts and small steps too."""
    rnd = np.random.RandomState(3)
    base, made = rnd.randn(64) * 0.12, []
    for size in (1000, 2000):
        x = base + rnd.randn(size, 64) * 0.011
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/{size}/embeddings.parquet")
        rows = {}
        made.append(rows_of_joins(spark, lambda: rows.update((r.vec_id, r) for r in llm.QUERIES["op6_fingerprints"](spark, f"{tmp_path}/{size}").collect())))  # noqa: B023
        if size == 1000:
            fp = {i: audio.fingerprint(audio.chroma_of_bins(v)) for i, v in enumerate(x)}
            want, got = collections.Counter(i for i, _ in searched(fp, range(0, size, 100))), rows
    assert made[1] <= 2.8 * made[0] and sum(r.links for r in rows.values()) > 10_000
    assert all(got[i].links <= want[i] for i in want) and sum(got[i].links for i in want) >= 0.9 * sum(want.values())
    for name, value in (("PACK_CODES", 520), ("PART_CODES", 5000), ("HITS", 20_000)):
        monkeypatch.setattr(audio, name, value)
    assert {r.vec_id: r for r in llm.QUERIES["op6_fingerprints"](spark, f"{tmp_path}/1000").collect()} == got
    pairs, _ = audio.alignments(spark.read.parquet(f"{tmp_path}/1000/embeddings.parquet"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)
    assert {r.a: r["count"] for r in pairs.groupBy("a").count().collect()} == {i: r.links for i, r in got.items() if r.links}


def test_histograms_in_steps():
    """Hits of equal keys by offset, in one step, in many, and for a pair with more hits than a step."""
    rnd = np.random.RandomState(4)
    codes = [rnd.randint(0, 3, rnd.randint(0, 60)).astype(np.uint32) * np.uint32(0x01010101) for _ in range(12)]
    off = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
    group = np.arange(12) % 2
    left, right = (audio.spots(np.concatenate(codes), off, rows, group) for rows in (np.arange(4), np.arange(4, 12)))
    left = [x[np.argsort(left[0], kind="stable")] for x in left]
    want = collections.Counter((int(a), int(b), int(t - s)) for v, a, s in zip(*left) for w, b, t in zip(*right) if v == w)
    assert len(want) > 100 and all(a % 2 == b % 2 for a, b, _ in want)
    for most in (1 << 20, 50, 3):
        got = [(int(a), int(b), int(s), int(n)) for part in audio.histograms(left, right, most) for a, b, s, n in zip(*part)]
        assert len(got) == len(want) and {(a, b, s): n for a, b, s, n in got} == want


# -- 7: mixing ---------------------------------------------------------------


def test_mixing_targets_and_shares(spark, sf):
    docs, size = documents(sf), collections.Counter()
    for _, t, _, s in docs:
        size[s] += len(WORD.findall(t))
    names = sorted(size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    level, free, left, target = 0.0, set(names), sum(size.values()), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= 3 * size[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    rows = llm.QUERIES["op7_mixing"](spark, sf).collect()
    taken = collections.Counter()
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert {r.doc_id: r.size for r in rows} == {d: len(WORD.findall(t)) for d, t, *_ in docs}
    assert sum(abs(taken[s] - target[s]) for s in names) <= 0.04 * sum(target.values())  # ten documents a source
    again = llm.QUERIES["op7_mixing"](spark, sf).collect()
    assert sorted(r.taken for r in rows) == sorted(r.taken for r in again)


def test_mixing_caps_and_awkward_rows(spark, corpus, nothing):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate([("a", 100), ("b", 1), ("b", 1), ("c", 50), (None, 30), ("z", 0)])], "doc_id long, text string, source string")
    got = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert got["b"] == 6 and got["z"] == 0 and got[None] + got["a"] + got["c"] + 6 == pytest.approx(182)
    assert mixing.mix(corpus).count() == corpus.count() and mixing.mix(nothing).count() == 0
    assert mixing.mix(nothing.unionByName(corpus.where("text = ''"))).first().taken == 0


# -- 8: language -------------------------------------------------------------


def test_presence_counts_ngrams():
    out = np.zeros(language.PLACES, bool)
    assert language.presence("Ab, ab!", out) and not language.presence("12 !", np.zeros(language.PLACES, bool)) and not language.presence(None, out)
    other = np.zeros(language.PLACES, bool)
    language.presence("aB. AB?", other)
    assert np.array_equal(out, other) and 5 <= out.sum() <= 10


def test_nystrom_with_all_rows_is_kernel_ridge_regression():
    rnd = np.random.RandomState(0)
    bits, labels = rnd.rand(30, language.PLACES) < 0.02, [("a", "b", "c")[i % 3] for i in range(30)]
    names, matrix = language.fit(bits, labels, 100, ridge=0.5)
    x = bits / np.sqrt(bits.sum(1, keepdims=True))
    y = np.where(np.array(labels)[:, None] == np.array(names)[None], 1.0, -1.0)
    k = x @ x.T
    want = k @ np.linalg.solve(k + 0.5 * 10 * np.eye(30), y)
    assert np.allclose(x @ matrix, want, atol=1e-3)


def test_language_accuracy(spark, sf):
    lang = {d: v for d, _, v, _ in documents(sf)}
    out = [r for r in llm.QUERIES["op8_language"](spark, sf).collect()]
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_on_awkward_rows(corpus, nothing):
    kept = {r.doc_id for r in language.keep_identified(corpus).collect()}
    assert kept >= set(range(12)) and not kept & {23, 24, 25, 26}
    assert language.keep_identified(corpus).columns == corpus.columns and language.keep_identified(nothing).count() == 0
    assert language.keep_identified(corpus.withColumn("lang", F.lit(None).cast("string"))).where("doc_id = 0").count() == 1


def test_language_sample_counts_copies_once(spark, monkeypatch):
    """A label that is mostly copies of one text still gives per_label distinct texts."""
    rnd = random.Random(8)
    text = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(6))
    few = [text() for _ in range(5)]
    rows = [("copied", t) for t in [text() for _ in range(300)] + [text()] * 6000] + [("few", t) for t in few * 800]
    seen = []
    monkeypatch.setattr(language, "fit", lambda bits, labels, n: seen.append((bits, labels)))
    language.train(spark.createDataFrame(rows, "lang string, text string"), per_label=40)
    bits, labels = seen[0]
    assert collections.Counter(labels) == {"copied": 40, "few": 5}
    assert len(np.unique(bits, axis=0)) == 45


# -- 9: near duplicates ------------------------------------------------------


def test_signature_distance_holds_pairs_at_the_threshold():
    for s in (neardup.CONTRACT, neardup.FIVE_WORDS):
        n, p = s.chunks * s.width, (1 - s.percent / 100) * 255 / 256
        assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(s.distance + 1, n + 1)) <= 1.5e-5
        assert s.chunks * (s.errors + 1) > s.distance and s.errors == 1


def groups(texts, k, percent):
    sets = {d: ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()) for d, w in ((d, words(t)) for d, t in texts)}
    label = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {d: lo if v == hi else v for d, v in label.items()}
    return sets, label


@pytest.mark.parametrize("scheme", [neardup.CONTRACT, neardup.FIVE_WORDS])
def test_near_duplicates_by_brute_force(spark, scheme, monkeypatch):
    """A large group of near copies, chains at the threshold, exact copies; small blocks, so all paths run."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "FEW", 6)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 4000)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 30)
    rnd = random.Random(7)
    vocab = [f"v{i}" for i in range(4000)]
    texts = []
    for size, edits in ((70, 14), (12, 5), (25, 9), (3, 1)):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(60, 150))]
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            texts.append(" ".join(own).upper() if rnd.random() < 0.2 else " ".join(own))
    texts += [texts[0]] * 5 + ["one two", "ONE two", "one", "", None, "  "]
    order = list(enumerate(rnd.sample(texts, len(texts))))
    sets, label = groups(order, scheme.k, scheme.percent)
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(5), scheme).collect()}
    assert {d: got[d].n_shingles for d in got} == {d: len(s) for d, s in sets.items()}
    assert {d: got[d].component_id for d in got} == label and all(got[d].kept == (label[d] == d) for d in got)


def test_all_pairs_within_the_distance_share_a_key():
    rnd, s = np.random.RandomState(0), neardup.CONTRACT
    assert s.chunks * (s.errors + 1) > s.distance
    n = s.chunks * s.width
    for _ in range(300):
        a = rnd.randint(0, 256, n).astype(np.uint8)
        b = a.copy()
        b[rnd.choice(n, s.distance, replace=False)] ^= 1
        x, y = neardup.keys_of(np.stack([a, b]), s)
        assert (x == y).any()


def test_near_duplicates_on_awkward_rows(corpus, nothing):
    got = collections.defaultdict(list)
    for r in neardup.near_duplicates(corpus, neardup.FIVE_WORDS).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == corpus.count() and got[21][0].component_id == got[20][0].component_id == 0 and {r.component_id for r in got[3]} == {3}
    assert all(r.component_id is None and r.kept for r in got[None]) and got[23][0].n_shingles == got[24][0].n_shingles == 0
    kept = neardup.drop_near_duplicates(corpus)
    assert kept.columns == corpus.columns and kept.where("doc_id in (20, 21)").count() == 0 and kept.where("doc_id = 0").count() == 1
    assert neardup.near_duplicates(nothing).count() == 0


def test_ids_that_are_no_integers_are_refused(spark):
    docs = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "some item text")], "item_id long, text string")
    for call in (lambda: neardup.near_duplicates(docs), lambda: decontaminate.leaks(docs, items)):
        with pytest.raises(TypeError):
            call()


def test_joins_without_broadcast_give_the_same(spark, corpus, monkeypatch):
    """The plans beyond the size that may be broadcast."""
    items = spark.createDataFrame([(1, " ".join((corpus.where("doc_id = 5").first().text).split()[3:40]))], "item_id long, text string")

    def results():
        out = [lines.without_recurring_lines(corpus), neardup.drop_near_duplicates(corpus), decontaminate.without_leaks(corpus, items), mixing.mixture(corpus), language.keep_identified(corpus)]
        return [sorted(map(str, x.collect())) for x in out]

    want = results()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert results() == want


def test_repeated_rows_in_stages(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a", "s", 0)] * 3 + [(2, text + " more", "a", "s", 0), (3, "own words of this one here", "a", "s", 0), (None, text, "a", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((r.doc_id or 0) for r in neardup.drop_near_duplicates(docs).collect()) == [0, 1, 3]
    two = spark.createDataFrame([(1, "one two three", "a", "s", 0), (1, "one", "a", "s", 0), (2, "x y", "a", "t", 0)], DOCS)
    got = mixing.mixture(two).collect()
    assert all(r["size"] == len(words(r.text)) and r.taken == r.copies * r["size"] for r in got)


# -- 10: lines ---------------------------------------------------------------


def test_lines(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))
    texts = [
        f"alpha beta gamma delta one\nVisit number 17 of the day today\n{passage}",
        f"Visit number 923 of the day today\nown words of the second text\n{passage}",
        "own words of the third paper\nHello dear user bob welcome back here\nx y",
        "Hello dear user alice welcome back here\nx y\nMore of its own right now",
        "Hello dear user carol welcome back here",
        "dup dup dup line\ndup dup dup line",
        None,
    ]
    got = {r.doc_id: r.text for r in lines.drop_lines(table(spark, texts)).collect()}
    assert got[0] == texts[0] and got[1] == "own words of the second text"  # the first keeps both
    assert got[2] == texts[2] and got[3] == "x y\nMore of its own right now" and got[4] == ""
    assert got[5] == texts[5] and got[6] is None
    kept = {r.doc_id: r.n_chars for r in lines.without_recurring_lines(table(spark, texts)).collect()}
    assert 4 not in kept and kept[1] == len(got[1]) and kept[0] == 0


def test_hot_template_keeps_its_fields(spark):
    """Two fields of words that all recur, over many documents, in one leaf: every line but the first document's goes."""
    rnd = random.Random(4)
    name = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    first, last = [name() for _ in range(60)], [name() for _ in range(60)]
    texts = [f"{name()} {name()}\nThanks for reading this post by {rnd.choice(first)} {rnd.choice(last)} today and ever" for _ in range(900)]
    out = lines.drop_lines(table(spark, texts)).collect()
    assert sum(r.n_dropped for r in out) == 899 and out[0].n_lines == 2


@pytest.mark.parametrize("form", ["Hello {} welcome back to our little shop today", "{} signed in to our little shop today again", "Dear friend {} welcome back to our shop today"])
@pytest.mark.parametrize("names", [400, 100])
def test_a_leading_token_may_be_a_field(spark, form, names):
    """A field at each of the leading places; names of one document, and of four; other lines of the same words stay."""
    rnd = random.Random(len(form))
    name = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    known, own = [name() for _ in range(names)], lambda: " ".join(name() for _ in range(9))
    texts = [f"{own()}\n{form.format(known[i % names])}\nHello {own()}" for i in range(400)]
    out = lines.drop_lines(table(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_dropped for r in out] == [0] + [1] * 399 and out[0].text == texts[0]
    assert all(r.text == t[: t.index("\n")] + t[t.rindex("\n") :] for r, t in zip(out[1:], texts[1:]))


def test_hot_leaf_is_split(spark, monkeypatch):
    """A leaf of many distinct lines: no exchange after the tokens are read deals its leading tokens out."""
    texts = [f"Same three words then {i:05d}x".replace("0", "o").translate(str.maketrans("123456789", "abcdefghj")) + " at last here" for i in range(3000)]
    seen, cut = [], lines.cut
    monkeypatch.setattr(lines, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    lines.drop_lines(table(spark, texts)).count()
    tokens = next(x for x in seen if "at" in x.columns)
    assert tokens.select(F.max(F.size("at"))).first()[0] == 5  # eight tokens without the three that lead


def test_lines_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(llm.ORACLE_SQL["op10_lines"]).fetchall())
    cols = "doc_id n_lines n_dropped n_chars text_sha256".split()
    assert sorted(tuple(r[c] for c in cols) for r in llm.QUERIES["op10_lines"](spark, sf).collect()) == want


def test_mixing_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for where in ("true", "doc_id % 3 > 0", "doc_id < 40"):
        con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet' WHERE {where}")
        want = sorted(con.sql(llm.ORACLE_SQL["op7_mixing"]).fetchall())
        got = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").where(where)).collect()
        assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken, r.source, r.copies) for r in got) == want


def test_near_duplicate_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(llm.ORACLE_SQL["op9_neardup"]).fetchall())
    cols = "doc_id n_shingles component_id kept".split()
    assert sorted(tuple(r[c] for c in cols) for r in llm.QUERIES["op9_neardup"](spark, sf).collect()) == want


def test_lines_on_awkward_rows(corpus, nothing):
    out = lines.without_recurring_lines(corpus)
    assert out.columns == corpus.columns and out.where("doc_id is null").count() == 2 and out.where("doc_id = 3").count() == 3
    assert lines.drop_lines(corpus).count() == corpus.count() and lines.without_recurring_lines(nothing).count() == 0


def test_lm_on_awkward_rows(corpus, nothing):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = hmm.language_model(corpus, held, states=3, init_rounds=2).collect()
    assert len(rows) == corpus.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (23, 24, 25))
    assert hmm.language_model(nothing, held).count() == 0
    assert all(math.isfinite(r.score) for r in hmm.language_model(corpus, F.lit(True), states=2).collect())


def test_lm_first_model_holds_a_bounded_number_of_tokens(spark):
    rows = [(np.arange(n, dtype=np.uint16).tobytes(), n) for n in (5, 400, 7, 9, 300, 11)]
    got = hmm.sample(spark.createDataFrame([(bytearray(s), n) for s, n in rows], "symbols binary, n_tokens long"), 10, 40)
    assert 0 < sum(map(len, got)) <= 40 and all(len(x) in (5, 7, 9, 11) for x in got)
    assert hmm.sample(spark.createDataFrame([], "symbols binary, n_tokens long"), 10, 40) == []


def test_lm_initial_sample_counts_copies_once(spark, monkeypatch):
    rnd = random.Random(9)
    text = lambda: " ".join(rnd.choice(("ba", "lo", "ti", "re", "su", "mon")) for _ in range(12))
    rows = [(i, t) for i, t in enumerate([text() for _ in range(150)] + [text()] * 3000)]
    seen, initial = [], hmm.initial
    monkeypatch.setattr(hmm, "initial", lambda texts, *more: seen.append(texts) or initial(texts, *more))
    hmm.language_model(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False), states=2, passes=0, init_texts=30, init_rounds=1)
    assert len(seen[0]) == 30 and len({x.tobytes() for x in seen[0]}) == 30
