import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fathomline.llm import kdsearch, mixing, packing, warc

TOKENS = public_tokenizers.path("word_bpe_49k.json")


# ---- packing


def check_packing(texts, rows, window=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENS)
    want = sorted((i, (*t.encode(x or "", add_special_tokens=False).ids, 2)) for i, x in texts)
    docs, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    got = []
    for (i, n), pieces in docs.items():
        copies = Counter(start for start, _ in pieces)[0]  # rows that repeat a document
        ordered = sorted(pieces, key=lambda p: p[0])
        for k in range(copies):
            own = [x for _, ids in ordered[k::copies] for x in ids]
            assert len(own) == n
            got.append((i, tuple(own)))
    assert sorted(got) == want
    total = sum(sum(n for _, n in p) for p in sequences.values())
    pad = sum(0 if (n := sum(x for _, x in p)) & (n - 1) == 0 else window - n for p in sequences.values())
    return pad / total


def test_packing_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert check_packing([tuple(r) for r in docs.collect()], packing.pack(docs, TOKENS).collect()) < 0.03


def test_packing_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "a " * 9000), (4, "don't I've <|endoftext|> x<|ENDOFTEXT|>y. a.,b 's. ÉÀ. é, İx ΑΣ. 3.14, a b!!! ..., a.. ﬁ."), (5, "x"), (6, "word " * 4095), (7, " a b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, sequence_id int")
    check_packing(texts, packing.pack(docs, TOKENS).collect())
    check_packing(texts, packing.pack(docs, TOKENS, window=64).collect(), 64)
    assert packing.pack(docs.limit(0), TOKENS).count() == 0
    assert packing.pack(spark.createDataFrame([(None, "x")], "doc_id long, text string"), TOKENS).count() == 1


def like_words(n):
    """Two words of n letters that hashes by powers of a base take for one."""
    a, flip = "a", str.maketrans("ab", "ba")
    while len(a) < n:
        a += a.translate(flip)
    return a[:n], a[:n].translate(flip)


def test_packing_tells_like_words_apart(spark):
    texts = [(i, w) for i, w in enumerate([*like_words(1024), *like_words(4096), *like_words(24)])]
    check_packing(texts, packing.pack(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), TOKENS).collect())


@pytest.mark.parametrize("keep", [1, 3])
def test_ids_hold_when_hashes_clash(monkeypatch, keep):
    """Units whose hashes are equal are told apart by their bytes."""
    import pyarrow as pa

    from fathomline.llm import tokens
    from fathomline.llm.textkernel import hash_ranges, words_of

    monkeypatch.setattr(tokens, "hash_ranges", lambda *a: hash_ranges(*a) % np.uint64(keep))
    monkeypatch.setattr(tokens, "EXACT", 0)  # it rests on the real hash
    encode = tokens.tokenizer(TOKENS)
    ids = tokens.WordIds(encode)
    for text in ("one three five and abcdefghi abcdefghj no. on, on", "other words abcdefghk abcdefghi again and on."):
        words = words_of(pa.array([text]))
        got, size = ids(words)
        assert got.tolist() == encode([(text, True)])[0] and len(size) == len(words.start)


def test_differencing():
    draw = random.Random(1)
    sizes = [draw.randrange(1, 900) for _ in range(300)]
    groups = packing.differencing(sizes, 32)
    assert sorted(i for g in groups for i in g) == list(range(300))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) - min(sums) < 40
    dealt = packing.deal([3000, 3000, 3000], 4096)
    assert len(dealt) == 3 and packing.deal([], 4096) == []


# ---- search


def brute_search(rows, k):
    ok = {i: [np.floor(256 * np.float64(x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, v in ok.items():
        if q % 50 == 0:
            scores = sorted((-int(np.dot(v, w)), i) for i, w in ok.items() if i != q and len(w) == len(v))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def test_search_against_brute_force(spark):
    draw = np.random.default_rng(0)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(700)]
    rows += [(i, rows[50][1]) for i in range(700, 760)]  # ties
    rows += [(800, None), (801, [1.0, None] * 4), (802, [float("nan")] * 8), (850, [float("inf")] * 8), (900, [1.0, 2.0]), (901, [1.0, 3.0]), (902, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    rows = [(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows]
    got = {tuple(r) for r in kdsearch.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    assert got == brute_search(rows, 5)
    assert kdsearch.top_k(df.limit(0), df.limit(0)).count() == 0


def test_search_descends_best_first_and_stays_exact():
    draw = np.random.default_rng(1)
    x = np.floor(draw.normal(size=(3000, 3)) * 50)
    order, nodes = kdsearch.build(x, 32)
    leaves = nodes[nodes[:, 2] < 0]
    assert sorted(order.tolist()) == list(range(3000)) and (leaves[:, 1] - leaves[:, 0]).max() <= 32
    x, low, high = x[order], *kdsearch.boxes(x[order], nodes)
    for (a, b, _), lo, hi in zip(nodes, low, high, strict=True):  # tight, inner nodes as well
        assert (x[a:b].min(0) == lo).all() and (x[a:b].max(0) == hi).all()
    q, qid = x[:40], order[:40]
    s, i = np.full((40, 4), -np.inf), np.full((40, 4), 1 << 62)
    for n in range(40):
        one = slice(n, n + 1)
        assert kdsearch.search(q[one], qid[one], x, order, nodes, (low, high), s[one], i[one]) < len(nodes) // 2
        want = sorted((-float(q[n] @ x[j]), order[j]) for j in range(3000) if order[j] != qid[n])[:4]
        assert [(-a, b) for a, b in zip(s[n], i[n], strict=True)] == want


def test_search_in_many_tiles(spark, monkeypatch):
    """Small shards, blocks, runs and chunks give the same rows."""
    for name, size in (("SHARD", 16), ("QUERIES", 3), ("RUN", 2), ("CHUNK", 2)):
        monkeypatch.setattr(kdsearch, name, size)
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=3 + i % 2).tolist()) for i in range(600)]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<double>, score double, ids string").repartition(5)
    assert {tuple(r) for r in kdsearch.top_k(df, df.where("vec_id % 50 = 0")).collect()} == brute_search(rows, 5)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [3e6 + i, 1.0]) for i in range(0, 60)] + [(100, [1e30, 1.0]), (150, [-1e30, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    got = {}
    for r in kdsearch.top_k(df, df.where("vec_id in (0, 50, 150)")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in (0, 50, 150):
        clip = lambda v: max(-(1 << 63), min((1 << 63) - 1, v))
        want = sorted((-clip(sum(a * b for a, b in zip(own[q], own[i], strict=True))), i) for i in own if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in want]
    twice = df.union(spark.createDataFrame([(0, [-1.0, 0.0])], df.schema))
    assert {r.rank for r in kdsearch.top_k(twice, twice.where("vec_id = 0")).collect()} == {1, 2, 3, 4, 5}


# ---- mixing


def plain_targets(sizes, most=3):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in free)
        level = left / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > most * sizes[i]}
        for i in over or free:
            target[i] = float(most * sizes[i]) if over else level * weights[i]
        free -= over or free
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 1000], [0, 5, 500, 3], [1, 1, 1, 1, 1, 5000], [7]])
def test_targets(spark, sizes):
    rows = [(i, "w " * n, f"s{i}", "clash") for i, n in enumerate(sizes)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, target string")).orderBy("doc_id").collect()
    assert [r.target for r in out] == pytest.approx(plain_targets(sizes))
    assert all(r.copies <= 3 for r in out)


def test_mixing_reruns_and_nulls(spark):
    rows = [(i, "a b c" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}") for i in range(200)] + [(None, "x", "s1"), (3, "a b c", "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(map(str, mixing.mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert a == b and len(a) == len(rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.repeat(mixing.mix(docs)).count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]


def test_mixing_joins_alike_without_a_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == want


def test_taken_words_come_near_the_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    per = mixing.mix(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert all(abs(r.taken / r.t - 1) < 0.25 for r in per) and abs(sum(r.taken for r in per) / sum(r.t for r in per) - 1) < 0.03


# ---- WARC


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, tmp_path, compression):
    same = "é" * 60
    rows = [(5, "http://a/b c\r\nX: y", same), (3, None, same), (9, "u", same), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", same), (7, "u", "x\r\n\r\nWARC/1.1\r\n" + "y" * 200), (3, None, same)]
    folder = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string"), folder, compression=compression)
    out = warc.read_warc(spark, folder).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r.page_id, []).append((r.record_type, r.refers_to_page, None if r.record_type == "revisit" else bytes(r.payload).decode()))
    assert got[5] == [("revisit", 3, None)] and got[9] == [("revisit", 3, None)]
    assert got[3] == [("response", None, same)] * 2 and got[None] == [("response", None, same)]
    assert got[1] == [("response", None, "short")] == got[2] and got[4] == [("response", None, "")]
    assert got[7][0][2] == rows[7][2]


def test_warc_pushdown_and_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame([(i, "u", f"page {i % 3} " * 30) for i in range(9)], "page_id long, url string, html string"), folder)
    hits = warc.read_warc(spark, folder).where("record_type = 'revisit' and refers_to_page = 1")
    assert sorted(r.page_id for r in hits.collect()) == [4, 7]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0] or "isnotnull" in plan
    assert warc.read_warc(spark, folder).where("refers_to_page in (null)").count() == 0
    reader = warc.WarcReader({"path": folder})
    from pyspark.sql.datasource import In, IsNotNull

    assert list(reader.pushFilters([In(("page_id",), (None,))])) == [] and not reader.wanted({"x-page-id": "1"})
    reader = warc.WarcReader({"path": folder})
    assert list(reader.pushFilters([IsNotNull(("page_id",))])) == [] and reader.wanted({"x-page-id": "1"}) and not reader.wanted({})
    bare = warc.read_warc(spark, folder, payload=False).where("record_type = 'response'").collect()
    assert len(bare) == 3 and all(r.payload is None for r in bare)
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_reader_skips_rejected_blocks():
    import io

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.taken += len(out)
            return out

    record = lambda kind, n: f"WARC/1.1\r\nWARC-Type: {kind}\r\nContent-Length: {n}\r\n\r\n".encode() + b"x" * n + b"\r\n\r\n"
    stream = Counting(record("response", 10_000) + record("metadata", 5) + record("response", 7))
    found = list(warc.parse(stream, lambda h: h["warc-type"] == "metadata", True))
    assert [p for _, p in found] == [b"xxxxx"] and Counting.taken == 5
