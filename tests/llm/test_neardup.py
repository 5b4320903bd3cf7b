import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from fathomline.llm import setsketch as S
from fathomline.llm.neardup import near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """{doc_id: (n_shingles, component)} by an exact prefix join."""
    sets, first = {}, {}
    for i, text in sorted(rows):
        w = WORD.findall((text or "").translate(LOWER))
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
        sets[i] = s
        if s:
            first.setdefault(s, i)
    df = Counter(x for s in first for x in s)
    up = {i: i for i in first.values()}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = defaultdict(list)
    for s in sorted(first, key=len):
        near = set()
        for x in sorted(s, key=lambda g: (df[g], g))[: len(s) - math.ceil(0.75 * len(s)) + 1]:
            near.update(index[x])
            index[x].append(s)
        for o in near:
            both = len(s & o)
            if 100 * both >= 75 * (len(s) + len(o) - both):
                a, b = find(first[s]), find(first[o])
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(first[s]) if s else i) for i, s in sets.items()}


def run(spark, rows, schema="doc_id long, text string"):
    return near_duplicates(spark.createDataFrame(rows, schema)).collect()


def test_edge_cases(spark):
    words = [f"w{i}" for i in range(60)]
    near = words[:30] + ["x"] + words[31:]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words).upper()), (1, None), (2, ""), (4, " \t\n"), (6, "one two"), (7, "ONE\ttwo "), (8, "one two three"), (None, "one two"), (10, "é" * 3), (11, "É" * 3), (12, " ".join(["again"] * 5000))]
    found = {r.doc_id: r for r in run(spark, rows)}
    want = brute([r for r in rows if r[0] is not None])
    for i, (n, c) in want.items():
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (n, c, i == c)
    assert found[None].component_id is None and found[None].kept and found[None].n_shingles == 1


def test_repeated_rows_extra_columns_and_empty_table(spark):
    rows = [(1, "a b c d e f g", 7, "x")] * 2 + [(2, "a b c d e f g", 8, "y")]
    out = run(spark, rows, "doc_id long, text string, n long, component string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert run(spark, []) == []


def test_large_loose_group_against_brute_force(spark):
    """Copies that are near a common text but often not near each other, and chains of them."""
    draw = random.Random(3)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(draw.choice((0, 1, 2, 2, 3))):
            w[draw.randrange(90)] = f"n{draw.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"z{draw.randrange(500)}" for _ in range(40))) for i in range(100)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, rows)}
    assert found == brute(rows)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert found == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_sketches_merge_and_estimate():
    draw = np.random.default_rng(1)
    a, b, c = (draw.integers(0, 2**64, n, dtype=np.uint64) for n in (300, 100, 100))
    left, right = np.concatenate([a, b]), np.concatenate([a, c])
    assert (np.maximum(S.sketch(a), S.sketch(b)) == S.sketch(np.unique(left))).all()
    x, y = S.sketch(left).astype(int), S.sketch(right).astype(int)
    got = S.similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([400.0]), np.array([400.0]))[0]
    assert abs(got - 0.6) < 0.08


def test_words_that_powers_of_a_base_confuse_are_told_apart(spark):
    a, b = "a", "b"
    while len(a) < 1024:
        a, b = a + b, b + a
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, [(1, a), (2, b), (3, f"x {a} y z w"), (4, f"x {b} y z w"), (5, a)])}
    assert found == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 1)}


def test_an_id_with_several_texts(spark):
    words = [f"w{i}" for i in range(40)]
    one, two = " ".join(words), " ".join(reversed(words))
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in run(spark, [(5, one), (5, two), (7, one), (9, two), (3, "alone")]))
    assert found == [(3, 1, 3), (5, 36, 5), (5, 36, 5), (7, 36, 5), (9, 36, 5)]


def test_outsiders_of_a_bucket_are_compared_with_all_its_members(spark, monkeypatch):
    """With blocks of 8, loose groups still give all links."""
    from fathomline.llm import neardup

    for name, size in (("SKETCH_BLOCK", 8), ("BLOCK", 4), ("LED_BLOCK", 2)):
        monkeypatch.setattr(neardup, name, size)
    draw = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(draw.choice((1, 2, 2, 3))):
            w[draw.randrange(60)] = f"n{draw.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, rows)} == brute(rows)


def test_estimates_rarely_miss_a_link():
    """At the limit's similarity few estimates lie below the cut, and such pairs share a band."""
    draw = np.random.default_rng(6)
    from fathomline.llm.neardup import LEAST_ESTIMATE

    low = apart = 0
    for n in range(400):
        size = int(draw.integers(30, 400))
        both = draw.integers(0, 2**64, -(-size * 6 // 7), dtype=np.uint64)
        x, y = (S.sketch(np.concatenate([both, draw.integers(0, 2**64, size - len(both), dtype=np.uint64)])) for _ in range(2))
        true = len(both) / (2 * size - len(both))
        assert 0.75 <= true < 0.79
        m = np.array([float(size)])
        est = S.similarity(np.array([(x.astype(int) > y).sum()]), np.array([(x.astype(int) < y).sum()]), m, m)[0]
        low += est < LEAST_ESTIMATE + true - 0.75
        bands = (x == y)[: S.ROWS * S.BANDS].reshape(S.BANDS, S.ROWS).all(1)
        apart += not bands.any()
    assert low <= 1 and apart == 0
