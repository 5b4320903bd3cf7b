"""Exact duplicates, ball k-means and source divergence against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import ballkmeans, divergence, exactdup
from fathomline.llm import queries as llm_queries
from fathomline.runtime import Scratch

from ..test_oracles import rows, tables  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_ball_kmeans", "op12_progressive_exact_dedup", "op13_source_divergence"])
def test_query_equals_its_sql(spark, tables, name):  # noqa: F811
    got, want = llm_queries.QUERIES[name](spark, SF).toPandas(), tables.sql(llm_queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# ---- exact duplicates

TEXTS = [(7, "a"), (3, "a"), (9, None), (2, ""), (4, "x" * 200_000), (5, "x" * 200_000), (6, "x" * 199_999 + "y"), (8, "A"), (None, "a"), (None, "only"), (7, "a"), (1, "é"), (11, "ab" * 40), (12, "ab" * 39 + "ba"), (None, "twice"), (None, "twice")]


def plain_duplicates(given):
    groups = defaultdict(list)
    for i, t in given:
        groups[t or ""].append(i)
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    return Counter((i, best(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in given)


@pytest.mark.parametrize("words,hot", [(1 << 20, 10_000), (1, 10_000), (1 << 20, 3), (1 << 20, 1)])
def test_duplicates(spark, monkeypatch, words, hot):
    monkeypatch.setattr(exactdup, "MAP_WORDS", words)
    monkeypatch.setattr(exactdup, "HOT", hot)
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in TEXTS], "doc_id long, text string, full string, size int").repartition(3)
    out = exactdup.exact_duplicates(docs, digest=True).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == plain_duplicates(TEXTS)
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in TEXTS})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)
    bare = exactdup.exact_duplicates(docs).collect()
    assert Counter(r[:4] for r in bare) == Counter(r[:4] for r in out)
    assert exactdup.exact_duplicates(docs.limit(0)).count() == 0


def test_texts_that_nothing_shares_are_not_read_to_their_end(spark):
    """Only rows whose length and beginning recur have a full hash; no step is Python."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    plan = exactdup.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    shared = exactdup._shared(docs.where("text is not null").selectExpr("length(text) as size"), "size")
    marked = exactdup._marked(docs.where("text is not null").selectExpr("doc_id", "length(text) as size"), shared, "open", "size")
    assert {r.doc_id for r in marked.where("not open").collect() if r.doc_id is not None} == {2}
    assert {r.doc_id for r in marked.where("open").collect()} >= {7, 3, 4, 5, 6, 8, 1, 11, 12}


# ---- ball k-means


def plain_kmeans(given, k, rounds, dim, scale=256, salt="2:"):
    own = [(i, [int(np.floor(scale * x)) if abs(x) < 1e15 else int(x) * scale for x in v], v) for i, v in given if v and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    text = lambda i: salt + ("null" if i is None else str(i))
    cent = [e for _, e, _ in sorted(own, key=lambda r: (hashlib.sha256(text(r[0]).encode()).hexdigest(), r[2]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        near = [min((far(e, c), j) for j, c in enumerate(cent)) for _, e, _ in own]
        if n < rounds:
            for j in range(len(cent)):
                mine = [e for (_, e, _), (_, c) in zip(own, near, strict=True) if c == j]
                if mine:
                    cent[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    per = Counter()
    for d, j in near:
        per[j] += d
    most = (1 << 63) - 1
    digest = lambda j: hashlib.sha256(",".join(map(str, cent[j])).encode()).hexdigest()
    return Counter((i, j, min(d, most), min(per[j], most), min(sum(per.values()), most), digest(j)) for (i, _, _), (d, j) in zip(own, near, strict=True))


def run_kmeans(spark, given, **settings):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in given], "vec_id long, embedding array<double>, cluster int, ids string").repartition(3)
    return Counter(tuple(r) for r in ballkmeans.clusters(df, **settings).collect())


def test_kmeans_against_plain(spark, monkeypatch):
    monkeypatch.setattr(ballkmeans, "BLOCK", 50)
    draw = np.random.default_rng(0)
    given = [(i, (draw.normal(size=4) + 3 * (i % 7)).tolist()) for i in range(400)]
    given += [(400 + i, given[5][1]) for i in range(60)] + [(5, given[5][1]), (5, given[6][1]), (None, given[7][1])]
    given += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [float("-inf")] * 4)]
    assert run_kmeans(spark, given, k=12, rounds=3, dim=4) == plain_kmeans(given, 12, 3, 4)
    assert run_kmeans(spark, given[:5], k=12, rounds=2, dim=4) == plain_kmeans(given[:5], 12, 2, 4)
    assert run_kmeans(spark, given[-6:], k=12, rounds=2, dim=4) == Counter()


def test_kmeans_beyond_doubles(spark):
    given = [(i, [float(i), -1e6 * i]) for i in range(30)] + [(50, [1e30, 1.0]), (51, [-1e30, 2.0]), (52, [1.7e308, 0.0]), (53, [3e15, 5.5])]
    assert run_kmeans(spark, given, k=5, rounds=3, dim=2) == plain_kmeans(given, 5, 3, 2)


def test_balls_compare_neighbours_only():
    draw = np.random.default_rng(3)
    centroids = np.floor(draw.normal(size=(40, 8)) * 4000)
    x = np.floor(centroids[np.repeat(np.arange(40), 50)] + draw.normal(size=(2000, 8)) * 700)
    want = ((x[:, None] - centroids[None]) ** 2).sum(2)
    first, near, looked = ballkmeans.assign(x, np.zeros(len(x), np.int64), centroids)
    assert (first == want.argmin(1)).all() and (near == want.min(1)).all()
    moved = centroids + 5
    again, near, looked = ballkmeans.assign(x, first, moved)
    want = ((x[:, None] - moved[None]) ** 2).sum(2)
    assert (again == want.argmin(1)).all() and (near == want.min(1)).all()
    assert looked < 3 * len(x)  # of 40 each
    tie, _, _ = ballkmeans.assign(np.array([[1.0]]), np.array([2]), np.array([[9.0], [0.0], [2.0], [2.0]]))
    assert tie.tolist() == [1]


# ---- source divergence


def plain_divergence(given, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [((a or ""), (b or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(lower))) for t, a, b in given]
    out = []
    for lang in {a for a, _, _ in docs}:
        mine = [(b, t) for a, b, t in docs if a == lang]
        df = Counter(x for _, t in mine for x in set(t))
        kept = {x for x, n in df.items() if n >= least}
        counts, v = defaultdict(Counter), len(kept)
        for b, t in mine:
            counts[b].update(x for x in t if x in kept)
        share = lambda c: {x: 1 + 10**9 * (c[x] + 2) // (sum(c.values()) + 2 * v) for x in kept}
        p, q = {b: share(c) for b, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for b in counts:
            pairs = sorted((-sum(f(p[b][x], p[o][x]) for x in kept), o.encode()) for o in counts if o != b)
            terms = sorted((-f(p[b][x], q[x]), x.encode()) for x in kept if counts[b][x] and p[b][x] > q[x])
            for part, own in (("pair", pairs), ("term", terms[:top])):
                out += [(lang, b, part, i.decode(), -value, n + 1) for n, (value, i) in enumerate(own)]
    return Counter(out)


def given_documents():
    draw = random.Random(4)
    words = ["alpha", "Beta", "γάμμα", "x", "X", "naïve", "o", "𐐀z", "longer"] + [f"w{'abcdefghij'[i]}" for i in range(10)]
    given = [(" ".join(draw.choices(words, k=draw.randrange(0, 30))) + "-1[" * (i % 2), draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "é", "", None])) for i in range(120)]
    return given + [(None, None, None), ("", "xx", "alone"), ("one two", "xy", "a"), ("one", "xy", "b"), ("q" * 70_000 + " " + "r " * 5000, "en", "s1"), ("one two", "xy", "b")]


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_divergence_against_plain(spark, monkeypatch, broadcast):
    monkeypatch.setattr(divergence, "MOST_BROADCAST", broadcast)
    given = given_documents()
    docs = spark.createDataFrame([(*r, 1, "t") for r in given], "text string, lang string, source string, n int, term string").repartition(3)
    for least, top in ((5, 3), (1, 10)):
        assert Counter(tuple(r) for r in divergence.source_divergence(docs, least, top).collect()) == plain_divergence(given, least, top)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_radix_top(spark, seed, monkeypatch):
    monkeypatch.setattr(divergence, "BITS", 16 if seed else 4)
    draw = random.Random(seed)
    items = sorted({"".join(draw.choices(["a", "b", "é", "𐐀", "\x00"], k=draw.randrange(0, 7))) for _ in range(150)})
    given = [(g, draw.choice([0, 5, 5, 5, 1 << 20, (1 << 40) + draw.randrange(3)]), "z" * 300 + i if g == 2 else i) for g in range(6) for i in draw.sample(items, len(items) if g else 3)]
    scratch = Scratch(spark, "test")
    df = scratch.save(spark.createDataFrame(given, "id long, value long, item string").repartition(3), "rows")
    got = Counter(tuple(r) for r in divergence.radix_top(df, "id", "value", "item", 7, scratch).collect())
    want = Counter()
    for g in range(6):
        want.update(sorted((r for r in given if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:7])
    assert got == want
    assert divergence.radix_top(scratch.save(df.limit(0), "none"), "id", "value", "item", 7, scratch).count() == 0


def test_shares_are_exact(spark):
    n, size = 123_456_789_012_345, 999_999_999_999_999
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(size), F.lit(7))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (size + 14)
