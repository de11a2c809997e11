"""Operators 11 to 13 against brute force, on awkward rows, hot groups and empty tables."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import centroids, common, trie, warc


@pytest.fixture
def parted(spark):
    """Range partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_join_groups_deals_out_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    monkeypatch.setattr(common, "SALTS", 8)
    rows = common.cut(spark.range(1000).select("id", F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k")))
    groups = common.cut(rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 2))
    got = common.join_groups(rows, groups, "k", "n").collect()
    assert sorted((r.id, r.k, r.n, r.x) for r in got) == sorted((i, *((0, 700, 0) if i < 700 else (i, 1, 2 * i))) for i in range(1000))


# -- 11: centroids -----------------------------------------------------------


def lloyd(rows, k, rounds, seed, dims, scale):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: ((r[0] is None), hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[near(v)[1]].append(v)
        centres = [[sum(x) // len(held[j]) for x in zip(*held[j])] if j in held else c for j, c in enumerate(centres)]
    return [(i, *near(v)[::-1]) for i, v in kept], centres


@pytest.mark.parametrize("spread", [1.0, 0.004, 20000.0])
def test_centroids_by_brute_force(spark, spread):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, spread) for _ in range(4)]) for i in range(150)]
    rows += [(200 + i, [0.5 * spread, -0.25 * spread, 0.0, 0.1]) for i in range(80)] + [rows[3], rows[3], (None, rows[5][1]), (7, rows[9][1])]
    rows += [(300, None), (301, []), (302, [1.0, 2.0, 3.0]), (303, [1.0, None, 2.0, 3.0]), (304, [float("nan")] * 4), (305, [float("inf"), 0.0, 0.0, 0.0]), (306, [-0.0] * 4)]
    table = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], "vec_id long, embedding array<double>, q int, digest string, m string")
    got, distinct, centres = centroids.clustered(table, k=9, rounds=3, seed=5, dims=4)
    want, wanted = lloyd(rows, 9, 3, 5, 4, 256)
    assert centres.tolist() == wanted
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got.collect()) == Counter(want)
    assert distinct.agg(F.sum("m")).first()[0] == len(want)


def test_centroids_with_few_vectors_or_none(spark):
    schema = "vec_id long, embedding array<float>"
    got, _, centres = centroids.clustered(spark.createDataFrame([], schema))
    assert got.count() == 0 and centres.shape == (0, 64)
    got, _, centres = centroids.clustered(spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64), (3, None)], schema))
    assert [(r.cluster, r.distance) for r in got.collect()] == [(0, 0), (0, 0)] and len(centres) == 2
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(spark.createDataFrame([(1, [3e38] * 64)], schema))


def test_nearest_is_exact_for_large_components():
    rnd = np.random.RandomState(1)
    x, c = rnd.randint(-centroids.LARGEST, centroids.LARGEST, (50, 64)), rnd.randint(-centroids.LARGEST, centroids.LARGEST, (7, 64))
    at, d = centroids.nearest(x, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for v in x]
    assert [(int(a), int(b)) for a, b in zip(d, at)] == want


# -- 12: revisits ------------------------------------------------------------


def archive(spark, pages, path, **more):
    warc.write_archives(spark.createDataFrame([(*p, "x", 1, "y") for p in pages], "page_id long, url string, html string, body string, key int, file string"), path, **more)


def test_base32_and_round_trip(spark, tmp_path):
    pages = [(1, "http://a/ü\r\nX: 1", "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (2, None, None), (3, "u", ""), (None, "v", "x" * 3_000_000), (4, "w", "\u0000퟿\U0001f600\n")]
    archive(spark, pages, f"{tmp_path}/raw", per_file=2)
    got = {r.page_id: r for r in warc.read_archives(spark, f"{tmp_path}/raw").collect()}
    assert len(got) == 5 and len(list((tmp_path / "raw").glob("*.gz"))) >= 3
    for i, url, html in pages:
        r, payload = got[None if i is None else str(i)], (html or "").encode()
        assert bytes(r.payload) == payload and r.payload_bytes == len(payload) and r.type == "response"
        assert r.digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert bytes(r.http).endswith(b"\r\n\r\n") and r.uri == (url or "").replace("\r\n", " ")
    plain = spark.createDataFrame([(p[2],) for p in pages], "t string").select(warc.base32_sha1(F.coalesce("t", F.lit("")))).collect()
    assert sorted(r[0] for r in plain) == sorted(r.digest for r in got.values())


@pytest.mark.parametrize("least", [0, 3])
def test_revisits_by_brute_force(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    monkeypatch.setattr(common, "SALTS", 4)
    rnd = random.Random(4)
    pages = [(i, f"http://h/{i}", rnd.choice(["same", "same", "same", "", None, "ab", "other", f"own{i}"])) for i in rnd.sample(range(-50, 200), 200)]
    pages += [pages[0], pages[0], (None, "n", "same"), (None, "n", "only null"), (None, "n", "only null")]
    archive(spark, pages, f"{tmp_path}/raw", per_file=30)
    warc.deduplicated(spark, f"{tmp_path}/raw", f"{tmp_path}/lean", least, per_file=30)
    records = common.cut(warc.read_archives(spark, f"{tmp_path}/lean").drop("payload", "fields"))
    got = Counter((r.page_id, r.payload_bytes, r.digest, r.type, r.refers_to_page) for r in warc.resolved(records).collect())
    order = lambda i: (i is None, i or 0)
    first, want = {}, Counter()
    for i, _, html in sorted(pages, key=lambda p: order(p[0])):
        text = html or ""
        again = text in first and len(text) >= least
        name = None if i is None else str(i)
        want[(name, len(text), base64.b32encode(hashlib.sha1(text.encode()).digest()).decode(), "revisit" if again else "response", first.get(text) if again else None)] += 1
        first.setdefault(text, name)
    assert got == want
    ids = {r.record_id: r for r in records.collect()}
    assert len(ids) == len(pages)
    for r in ids.values():
        if r.type == "revisit":
            to = ids[r.refers_to]
            assert (r.refers_to_uri, r.refers_to_date, r.profile, r.payload_bytes) == (to.uri, to.date, warc.PROFILE, 0) and to.digest == r.digest


def test_revisits_that_archives_hold_already(spark, tmp_path):
    def record(kind, n, payload=b"", **more):
        digest = base64.b32encode(hashlib.sha1(more.pop("of", payload)).digest()).decode()
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{n}>", "WARC-Date: 2020-01-01T00:00:00Z", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items())]
        block = payload if kind == "warcinfo" else b"HTTP/1.1 200 OK\r\nX-\xff: 1\r\n\r\n" + payload
        head += ["Content-Type: text/plain" if kind == "warcinfo" else "content-type: application/http; msgtype=response", *([] if kind == "warcinfo" else [f"WARC-Payload-Digest: sha1:{digest}"]), f"Content-Length: {len(block)}"]
        return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    kept = [record("warcinfo", "i", b"software: x"), record("response", "a", b"\xff\x00one", WARC_IP_Address="1.2.3.4"), record("revisit", "r", of=b"\xff\x00one", WARC_Refers_To="<urn:lost>"), record("revisit", "s", of=b"nowhere", WARC_Refers_To="<urn:else>")]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, kept)))
    warc.deduplicated(spark, f"{tmp_path}/raw", f"{tmp_path}/lean")
    got = {r.type + (r.refers_to or ""): r for r in warc.read_archives(spark, f"{tmp_path}/lean").collect()}
    assert set(got) == {"warcinfo", "response", "revisit<urn:a>", "revisit<urn:else>"}
    assert bytes(got["response"].payload) == b"\xff\x00one" and bytes(got["response"].http) == b"HTTP/1.1 200 OK\r\nX-\xff: 1\r\n\r\n"
    assert got["response"].fields["warc-ip-address"] == "1.2.3.4" and bytes(got["warcinfo"].payload) == b"software: x"
    for cut, why in ((10, "header"), (-8, "block")):
        (tmp_path / "raw" / "two.warc.gz").write_bytes(gzip.compress(kept[1][:cut]))
        with pytest.raises(Exception, match=f"two.warc.gz: record 0 ends within its {why}"):
            warc.read_archives(spark, f"{tmp_path}/raw").collect()


def test_revisits_of_no_pages(spark, tmp_path):
    archive(spark, [], f"{tmp_path}/raw")
    warc.deduplicated(spark, f"{tmp_path}/raw", f"{tmp_path}/lean")
    assert warc.resolved(common.cut(warc.read_archives(spark, f"{tmp_path}/lean").drop("payload"))).count() == 0


# -- 13: prefix trie ---------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + v[h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append((c, d == len(seq)))
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    least = {p: min(c for c, _ in m) for p, m in nodes.items()}
    sha = lambda m: hashlib.sha256(",".join(str(c) for c, e in sorted(m) if e).encode()).hexdigest()
    return Counter((least[p], len(p), least[p[:-1]] if p else None, len(m), kids[p], leaves[p], saved[p], sha(m)) for p, m in nodes.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_rows():
    rnd = random.Random(6)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 220), *range(-120, -90)]:
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, rnd.choice(["user", "user", None]), rnd.choice(["a", "b", "", None, "é" * 3])))
    rows += [(c, t, "user", f"long {t}") for c in (300, 301) for t in range(120)]
    rows += [rows[0], rows[0], (5, None, "x", "first"), (5, None, "x", "y"), (None, 1, "user", "lost"), (400, None, None, None)]
    rnd.shuffle(rows)
    return rows


def test_trie_by_brute_force(parted, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 20)
    monkeypatch.setattr(common, "SALTS", 4)
    monkeypatch.setattr(trie, "BLOCK", 16)
    monkeypatch.setattr(trie, "PACK", 20)
    rows = conversation_rows()
    table = parted.createDataFrame([(*r, "a", "b", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, node string, len int")
    got = trie.trie(table.repartition(5))
    assert Counter(tuple(r) for r in got.select(COLUMNS).collect()) == plain_trie(rows)


def test_trie_of_no_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.trie(spark.createDataFrame([], schema)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    got = trie.trie(spark.createDataFrame([(turnless, 1, "a", "b")], schema)).select(COLUMNS).collect()
    assert [tuple(r) for r in got] == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    with pytest.raises(TypeError):
        trie.trie(spark.createDataFrame([("x", 1, "a", "b")], schema.replace("conv_id long", "conv_id string")))
