import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.llm import language, personal, quality, secrets, toxicity
from fathomline.llm.textkernel import U64, hash_ranges, mix, words_of

DOCS = "/root/testdata/sf0.01/documents.parquet"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "é" * 50), (5, "a\n\na\nb \na"), (6, "x " * 30_000), (7, "one two three four five six"), (7, "one two three four five six"), (None, "null id")]


def odd(spark, extra=True):
    if extra:
        return spark.createDataFrame([(i, t, "x", 1.0, True) for i, t in ODD], "doc_id long, text string, spans string, score double, kept boolean")
    return spark.createDataFrame(ODD, "doc_id long, text string")


# ---- words


def test_words_and_windows():
    texts = ["a b\x0bc\td", "", "  é è ", "a b c d e a b c d e"]
    w = words_of(pa.array(texts))
    raw = w.data.tobytes()
    got = [[raw[s:e].decode() for s, e, d in zip(w.start, w.end, w.doc, strict=True) if d == i] for i in range(len(texts))]
    assert got == [WORD.findall(t) for t in texts]
    at, h = w.windows(5)
    assert len(at) == 6 and h[0] == h[5]
    assert len(set(w.hash.tolist())) == len(set(re.findall(WORD, " ".join(texts))))


# ---- quality


def brute_quality(x):
    w, lines, dup = WORD.findall(x), set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    mark = [0] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            mark[i : i + 5] = [1] * 5
    n, r = len(w), sum(mark)
    return n, sum(map(len, w)), len(re.findall("[#*$%&|<>]", x)), dup, r, n < 10 or 100 * r > 20 * n


def test_quality_counts(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text").union(odd(spark, False))
    texts = {(r.doc_id, r.text): brute_quality(r.text or "") for r in docs.collect()}
    rows = quality.rate_quality(docs, PIECES).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "entropy").collect()
    got = Counter((r[0], *r[1:7]) for r in rows)
    assert got == Counter((i, *brute_quality(t or "")) for i, t in [(r.doc_id, r.text) for r in docs.collect()]) and texts
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality.rate_quality(docs.limit(0), PIECES).count() == 0


def test_quality_keeps_columns_and_good_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1")
    kept = quality.keep_good(docs, PIECES)
    assert kept.columns == docs.columns
    good = quality.rate_quality(docs.join(labels, "doc_id", "left_semi"), PIECES).where("not base_failed")
    assert good.where("not kept").count() < 0.003 * good.count()
    assert quality.keep_good(odd(spark), PIECES).columns == odd(spark).columns


def test_bands_alone_reject_bad_documents(spark):
    """Of documents that the floors were not set on."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    bad = docs.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 0"), "doc_id", "left_semi")
    passed = quality.rate_quality(bad, PIECES).where("not base_failed")
    assert passed.where("not kept").count() > 0.75 * passed.count() > 0


def test_fertility_of_one_text():
    encode, is_byte = quality.word_ids("pieces", PIECES), quality._byte_pieces(PIECES)
    text = "the cat\nand  the dog\t"
    found = quality.measure(pa.RecordBatch.from_pydict({"text": pa.array([text, "ᚠᚡᚢ ᚣ", None])}), encode, is_byte)
    import sentencepiece

    ids = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)
    assert found["n_tokens"][0].as_py() == len(ids) and found["chars_per_token"][0].as_py() == len(text) / len(ids)
    c = np.array(list(Counter(ids).values())) / len(ids)
    assert found["entropy"][0].as_py() == pytest.approx(-(c * np.log2(c)).sum() / np.log2(len(ids)))
    assert found["byte_share"][0].as_py() == 2 / len(ids)
    assert found["byte_share"][1].as_py() > 0.5 and found["chars_per_token"][2].as_py() is None


def test_units_give_the_whole_texts_tokens(spark):
    import random

    import sentencepiece

    from fathomline.llm.tokens import Units, word_ids

    loaded, encode = sentencepiece.SentencePieceProcessor(model_file=PIECES), word_ids("pieces", PIECES)
    draw = random.Random(4)
    letters = " \t\n\r\x0b\x0c  aabcé中▁.,;{}()<s>/Ⅳﬁ\u3000\xa0\x00٣x"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(30))) for _ in range(3000)] + [None, "", "▁", "\n", " ", "a" * 5000]
    texts += [r.text for r in spark.read.parquet(DOCS).collect()]
    units = Units(pa.array(texts), encode.alone)
    ids, size = encode(units)
    ends = np.concatenate(([0], np.cumsum(size)))[units.first]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [loaded.encode(t or "") for t in texts]


def test_bands_by_language_and_script(spark):
    rows = [(1, "the same words " * 3 + " | ".join("abcdefghij") * 40, "en"), (2, "один два три четыре пять шесть семь восемь девять десять слов", None), (3, "the cat sat on the mat and then it went out to play in the sun", "xx")]
    by = {r.doc_id: r for r in quality.rate_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    assert [by[i].band for i in (1, 2, 3)] == ["en", "cyrillic", "latin"]
    assert not by[1].kept and by[2].kept and by[3].kept
    assert quality.rate_quality(spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, lang int"), PIECES).columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


# ---- secrets


def plain_secrets(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 8]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(secrets.KINDS[k], a, b) for k, a, b in sorted(out, key=lambda s: (s[1], s[0]))]


@pytest.fixture(scope="module")
def field(spark):
    return secrets.train(spark.read.parquet(DOCS))


def test_field_is_fitted_away_from_the_driver(spark, field, monkeypatch):
    def here(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(secrets, "fit", here)
    again = secrets.train(spark.read.parquet(DOCS).repartition(3))
    assert field.own.any() and all((getattr(field, w) == getattr(again, w)).all() for w in secrets.Field.SHAPES)


def test_secret_spans(spark, field):
    tricky = [(1000050, 'é PassWord" : "abcdefgh!, token=short secret=secret=abcdefgh'), (1000051, "AKIAAKIAABCDEFGHIJ AKIA123"), (1000052, "deadbeef" * 4 + "g" + "0" * 31), (1000053, "x=AKIA" + "A" * 12 + " api-key=12345678 apikey = '12345678'")]
    docs = spark.read.parquet(DOCS).select("doc_id", "text").union(spark.createDataFrame(tricky, "doc_id long, text string")).union(odd(spark, False).where("doc_id <> 7"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    spans = lambda s: [(x.kind, x.start, x.end) for x in s]
    for r in secrets.find_secrets(docs, field).collect():
        want = plain_secrets(texts[r.doc_id])
        assert spans(r.base_spans) == want, r.doc_id
        assert set(want) <= set(spans(r.spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for k, _, _ in want) for n in secrets.KINDS)
    assert secrets.find_secrets(docs.limit(0), field).count() == 0


@pytest.fixture(scope="module")
def taught(spark):
    """A field that has seen two thirds of the documents."""
    return secrets.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 <> 0"))


def test_field_finds_planted_secrets_of_forms_it_was_not_shown(spark, taught):
    """Recall and precision of the field's own spans on texts that it has not seen."""
    draw = np.random.default_rng(9)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 = 0").collect()
    texts = [r.text for r in docs if r.text and 200 < len(r.text) < 4000 and not secrets.base_spans(r.text)][:210]
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    some = lambda n: "".join(draw.choice(letters, n))
    forms = [lambda: f"ghp_{some(36)}", lambda: f"sk-live-{some(24)}", lambda: f"eyJ{some(20)}.{some(40)}.{some(30)}", lambda: draw.bytes(20).hex().upper(), lambda: f"xoxb-{some(10)}-{some(24)}"]
    harmless = ["https://www.example.org/about/page12?id=7", "jane.doe22@mail.example.com", "2024-05-17", "4111-2222", "getUserName2", "rev2.31.4", "Donaudampfschifffahrtsgesellschaft"]
    rows, where = [], []
    for i, text in enumerate(texts):
        words, value = text.split(" "), forms[i % 5]() if i % 2 else harmless[i % 7]
        words.insert(int(draw.integers(1, len(words))), value)
        rows.append(" ".join(words))
        where.append((rows[-1].index(value), rows[-1].index(value) + len(value)) if i % 2 else None)
    hit = false = 0
    for own, (_, spans) in zip(where, secrets.scan(pa.RecordBatch.from_pydict({"text": rows}), taught), strict=True):
        for s in spans:
            inside = own and s["start"] < own[1] and s["end"] > own[0]
            false += not inside
        hit += bool(own) and sum(max(0, min(s["end"], own[1]) - max(s["start"], own[0])) for s in spans) > (own[1] - own[0]) / 2
    assert hit >= 0.9 * sum(map(bool, where)) and false <= 3


def test_field_learns_secrets_without_the_patterns(spark, taught):
    """Secrets that a pattern names are also tagged by shape and neighbours, and prose is not."""
    field = taught
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 = 0").collect()
    hit = total = false = 0
    for r in docs:
        text = r.text or ""
        values = secrets._values(text, secrets.base_spans(text))
        w = words_of(pa.array([text]))
        found = [(w.start[a], w.end[b - 1]) for _, a, b in secrets.decode(field, w)]
        for a, b in values:
            a, b = len(text[:a].encode()), len(text[:b].encode())
            total += 1
            hit += any(x < b and y > a for x, y in found)
        false += not values and bool(found)
    assert total > 20 and hit / total > 0.7
    assert false / len(docs) < 0.01


def test_field_learns_secrets_of_several_tokens_and_short_ones(spark):
    """Values with signs and over lines train the inside tag; unseen ones, and one of 10 characters, are found."""
    draw = np.random.default_rng(3)
    abc = np.array(list("abcdefghijkmnpqrstuvwxyz23456789"))
    word = lambda n: "".join(draw.choice(abc, n - 2)) + "7q"
    rows = [(i, f"the service reads its key here\n{'0123456789abcdef' * 2}{draw.integers(10**8):08d}\n{'fedcba98' * 4}{draw.integers(10**8):08d}\nand then goes on") for i in range(150)]
    rows += [(1000 + i, f"config sets secret={word(10)} for all users and token={word(9)}-{word(8)}/{word(7)} for one") for i in range(300)]
    rows += [(2000 + i, f"the service reads its page {i} and then config sets nothing for all users = {i} times") for i in range(300)]
    field = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))
    short, long_, block = "k3v9m2xw7q", "p4t8-z6w2k9/m5b3", "00112233445566778899aabbccddeeff0011\n99aabbcc"
    texts = [f"config sets secret=\t{short} for all users", f"config sets secret={short} for all", f"and token={long_} for one", f"the service reads its key here\n{block}\nand then goes on", "the service reads its page 7 and then config sets nothing for all users = 7 times"]
    words = secrets.Tokens(words_of(pa.array(texts)))
    raw = words.data.tobytes()
    found = {}
    for doc, a, b in secrets.decode_tokens(field, words):
        found.setdefault(doc, []).append(raw[a:b].decode())
    assert field.own[:, secrets.INSIDE].max() > 0
    assert found.get(1) == [short] and found.get(2) == [long_] and found.get(3) == [block] and 4 not in found
    # neither the value behind a tab nor the block's last line is a pattern's
    added = [[t[s["start"] : s["end"]] for s in spans if s["kind"] == "field"] for t, (_, spans) in zip(texts, secrets.scan(pa.RecordBatch.from_pydict({"text": texts}), field), strict=True)]
    assert added == [[short], [], [], ["99aabbcc"], []]


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(2)
    e, move = draw.normal(size=(5, 3)), draw.normal(size=(3, 3))
    move[0, 2] = -1e4
    import itertools

    score = lambda p: e[range(5), p].sum() + sum(move[a, b] for a, b in itertools.pairwise(p)) - 1e4 * (p[0] == 2)
    assert tuple(secrets.viterbi(e, move)) == max(itertools.product(range(3), repeat=5), key=score)
    p, pair = secrets.posterior(e[None], move)
    assert np.allclose(p.sum(2), 1) and np.allclose(pair.sum((2, 3)), 1) and np.allclose(pair.sum(2)[0], p[0, 1:])


def test_masking(spark, field):
    docs = spark.createDataFrame([(1, "é token = abcdefgh1 end", 5), (2, None, 0)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r.text for r in secrets.mask_secrets(docs, field).collect()}
    assert out == {1: "é <SECRET> end", 2: None}


def test_masking_leaves_no_tail_of_nested_spans(spark):
    texts = [f"x token={'0a' * 20}.REST y", f"api_key=AKIA{'B' * 12}-rest token=abcdefgh"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in secrets.mask_secrets(docs, secrets.fit([])).collect()}
    assert out == {0: "x <SECRET> y", 1: "<SECRET> <SECRET>"}


def test_secrets_without_any_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "plain words only"), (2, None)], "doc_id long, text string")
    assert all(r.spans == [] for r in secrets.find_secrets(docs).collect())


# ---- personal data


def plain_personal(t):
    found = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, p in enumerate(patterns):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x.lstrip("0")[:5] or "0") > 255 for x in m[0].split(".")) or k == 2 and not (13 <= len(d) <= 19 and personal.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            found.append((personal.KINDS[k], m.start(), m.end()))
    return found


def test_personal_spans(spark):
    tricky = [(1000060, "a@b a@b.c@d.e é.x@y-z.co.uk, @x.y a@@b.c 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 .1.2.3.4"), (1000061, "4111 1111-1111 1111 41111111111111112 +1 (555) 010-9999 +1234567 +12-34-56-789."), (1000062, "0" * 5000 + " " + "a" * 5000 + "@"), (1000063, "+1((((" * 200), (1000064, "0" * 5000 + "1.2.3.4 0" + "0" * 4400 + ".0.0.255 9" + "0" * 4400 + ".1.1.1")]
    docs = spark.read.parquet(DOCS).select("doc_id", "text").union(spark.createDataFrame(tricky, "doc_id long, text string")).union(odd(spark, False).where("doc_id <> 7"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in personal.find_personal(docs).collect():
        want = plain_personal(texts[r.doc_id])
        assert [(x.kind, x.start, x.end) for x in r.base_spans] == want, r.doc_id
        assert r.spans[: len(want)] == r.base_spans
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in want) for n in personal.KINDS)
    assert personal.find_personal(docs.limit(0)).count() == 0


def personal_corpus():
    """Phrases that introduce identifiers which no pattern names, others that do not, and what to find."""
    draw = np.random.default_rng(8)
    d = lambda n: "".join(draw.choice(list("0123456789"), n))
    rows, want = [], {}
    for i in range(400):
        known, unseen = f"user{d(4)}@mail{d(2)}.example.com", [f"user{d(4)}@intranet{d(2)}", f"{d(3)} {d(3)} {d(4)}", f"999.{d(3)}.{d(3)}.1"][i % 3]
        value = unseen if i % 20 == 0 else known
        rows.append((i, f"é page {i}: please contact user {value} today for the model{d(5)} engine, version {d(4)}.{d(3)}"))
        if value is unseen:
            want[i] = unseen
        rows.append((1000 + i, f"the order number {d(3)} {d(4)} shipped on day 2024{d(4)} as asked"))
    return rows, want


def test_context_finds_identifiers_that_no_pattern_names(spark):
    """Of identifiers planted behind a phrase that also introduces addresses all are found, those of
    several words whole; numbers behind other phrases are left alone."""
    rows, want = personal_corpus()
    text = dict(rows)
    out = personal.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "context"] for r in out}
    assert {i: f for i, f in found.items() if f} == {i: [w] for i, w in want.items()} and len(want) == 20


def test_context_is_not_trusted_where_others_stand_in_it(spark):
    rows = [(i, f"please contact user user{i}x@mail.example.com now") for i in range(30)] + [(100 + i, f"please contact user item{i}0000 now") for i in range(10)]
    out = personal.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not any(s.kind == "context" for r in out for s in r.spans)


def brute_trust(graph, rounds, trust, support, accept):
    seeds = {i for _, i, s in graph if s}
    known, pairs = dict.fromkeys(seeds, 1.0), {(p, i) for p, i, _ in graph}
    for _ in range(rounds):
        per = {}
        for p, i in pairs:
            per.setdefault(p, []).append(known.get(i, 0.0))
        good = {p: sum(v) / (len(v) + personal.DOUBT) for p, v in per.items() if sum(x >= accept for x in v) >= support}
        good = {p: t for p, t in good.items() if t >= trust}
        score = {}
        for p, i in pairs:
            if p in good:
                score[i] = 1 - (1 - score.get(i, 0.0)) * (1 - min(good[p], 0.999))
        known = {i: s for i, s in score.items() if s >= accept} | dict.fromkeys(seeds, 1.0)
    return {(p, i) for p, i in pairs if p in good and i in known}


def test_bootstrap_against_a_plain_version(spark):
    from fathomline.runtime import Scratch

    draw = np.random.default_rng(3)
    graph = {}
    for _ in range(900):
        p, i = int(draw.integers(12)), int(draw.integers(200))
        graph[p, i] = i % 100 < 93 if p < 8 else False
    graph = [(p, i, bool(s and i % 100 < 93)) for (p, i), s in graph.items()]
    df = spark.createDataFrame(graph, "pattern long, instance long, seed boolean")
    got = {tuple(r) for r in personal.bootstrap(df, Scratch(spark, "test"), trust=0.8).collect()}
    assert got == brute_trust(graph, personal.ROUNDS, 0.8, personal.SUPPORT, personal.ACCEPT) and any(i % 100 >= 93 for _, i in got)


# ---- toxicity


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.score_toxicity(docs, labels)
    both = out.join(labels, "doc_id").where("toxic is not null and held_out").toPandas()
    assert (both.predicted == both.toxic).mean() > 0.95
    assert both[both.toxic == 0].predicted.mean() < 0.02 and both.score.between(0, 1).all()
    assert out.where("predicted <> cast(score >= 0.5 as int)").count() == 0


def test_toxicity_edge_cases(spark):
    labels = spark.createDataFrame([(7, 1), (7, 0), (4, None)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(odd(spark), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    none = toxicity.score_toxicity(odd(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.score_toxicity(odd(spark).limit(0), labels).count() == 0


def plain_features(text):
    """Feature numbers of a text's words, without signs at either end, and of their beginnings."""
    out = set()
    for w in re.findall(rb"[^ \t-\r]+", text.encode()):
        w = re.sub(rb"^[^0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+$", b"", w)
        for n in (0, *toxicity.PREFIXES):
            if len(w) > n:
                part = w[:n] if n else w
                out.add(int(mix(hash_ranges(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)])) + np.uint64(n))[0]) & ((1 << toxicity.BITS) - 1))
    return out


def test_toxicity_scores_against_a_plain_version(spark):
    weights = np.random.default_rng(4).normal(size=(1 << toxicity.BITS) + 1)
    rows = [r for r in spark.read.parquet(DOCS).select("doc_id", "text").limit(60).collect()] + [(5000, None), (5001, "--- ..."), (5002, "(Mixed) CASE, mixed case; it's été!")]
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    for r in toxicity.score_toxicity(docs, weights=weights).collect():
        text = dict(map(tuple, rows))[r.doc_id] or ""
        lowered = "".join(c.lower() if c.isascii() else c for c in text)
        want = 1 / (1 + np.exp(-np.clip(sum(weights[f] for f in plain_features(lowered)) + weights[-1], -30, 30)))
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == int(r.score >= 0.5)


def named_sentences(n, seed):
    """Toxic sentences name one group often, others seldom; neutral ones of either group."""
    draw = np.random.default_rng(seed)
    texts, y = [], []
    filler = [f"word{k}" for k in range(60)]
    for i in range(n):
        bad = i % 2
        group = ["muslims"] if draw.random() < (0.8 if bad else 0.02) else ["christians"] if draw.random() < 0.2 else []
        sting = [str(draw.choice(["awful", "stupid", "filthy"]))] if bad and draw.random() < 0.8 else ["pleasant"] if draw.random() < 0.5 else []
        words = [*group, *sting, *draw.choice(filler, 6)]
        texts.append(" ".join(words[k] for k in draw.permutation(len(words))))
        y.append(bad)
    return texts, np.array(y)


def test_counterfactuals_lower_scores_of_neutral_mentions():
    """At the penalty in use a swapped sentence scores nearly alike, and neutral sentences that name
    the group, none of which was taught, are less often called toxic; insults still are."""
    texts, y = named_sentences(2000, 0)
    words = words_of(pa.array(texts))
    rows, shared = toxicity.word_features(words), toxicity.word_features(words, True)
    draw = np.random.default_rng(1)
    neutral = [" ".join(["muslims", *draw.choice([f"word{k}" for k in range(60)], 6)]) for _ in range(300)]
    swapped = [t.replace("muslims", "christians") for t in neutral]
    toxic = [f"{t} filthy" for t in neutral]
    result = {}
    for penalty in (0.0, toxicity.COUNTERFACTUAL):
        w = toxicity.fit(rows, y, penalty=penalty, shared=shared)
        score = lambda ts: np.array([1 / (1 + np.exp(-w[f].sum() - w[-1])) for f in toxicity.word_features(words_of(pa.array(ts)))])  # noqa: E731, B023
        result[penalty] = (np.abs(score(neutral) - score(swapped)).mean(), (score(neutral) >= 0.5).mean(), (score(toxic) >= 0.5).mean())
    (gap0, wrong0, _), (gap, wrong, hit) = result[0.0], result[toxicity.COUNTERFACTUAL]
    assert gap < 0.3 * gap0 and gap < 0.12 and wrong < 0.5 * wrong0 and hit > 0.9, result
    # two different words of a text may share a beginning
    shared = toxicity.word_features(words_of(pa.array(["muslims muslims sell muslin", "muslims muslims"])), True)
    assert len(shared[0]) == 2 and len(shared[1]) == 0


def test_samples_are_bounded_by_their_features(spark):
    from fathomline.llm.holdout import within

    rows = spark.createDataFrame([(k, 10) for k in range(20)] + [(3, 5)], "key long, size long")
    assert sorted(r.key for r in within(rows, 40).collect()) == [0, 1, 2, 3, 3]
    assert within(rows, 10**6).count() == 21 and within(rows.limit(0), 5).count() == 0


# ---- language


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = language.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.99 and out.score.between(0, 1).all()


def test_language_edge_cases(spark):
    docs = odd(spark).withColumn("lang", F.when(F.col("doc_id") == 7, "en").when(F.col("doc_id") == 6, "xx"))
    out = language.predict_language(docs).collect()
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))
    assert by[7].lang_pred in ("en", "xx")
    nothing = language.predict_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.predict_language(docs.limit(0)).count() == 0


def test_grams_against_a_plain_count():
    texts = ["Ab ab é1c", "", "xyz", None]
    g = language.Grams(pa.array(texts))
    assert g.letters.tolist() == [6, 0, 3, 0]
    # " ab ": a, b, " a", "ab", "b ", " ab", "ab "
    assert g.total[2] == 3 + 4 + 3 and g.total[1] == 0
    per = language.Grams(pa.array(["ab ab", "ab"])).total
    assert per[0] == 2 * per[1]


def test_calibration_finds_the_scale():
    draw = np.random.default_rng(4)
    logits = draw.normal(size=(4000, 3)) * 2
    p = language.softmax(logits)
    labels = np.array([draw.choice(3, p=q) for q in p])
    assert language.calibrate(logits * 3, labels) == pytest.approx(3, rel=0.2)


def plain_grams(text):
    """Counts of the features of a text's n-grams, letter by letter."""
    out = Counter()
    letter = lambda c: (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
    for w in WORD.findall(text):
        w = re.sub(" +", " ", f" {''.join(map(letter, w))} ")
        for n in (1, 2, 3):
            for k in range(len(w) - n + 1) if w.strip() else ():
                g = w[k : k + n]
                if n == 1 and g == " ":
                    continue
                h = np.array([ord(g)], U64) if n == 1 else np.array([(sum(ord(c) * int(o) for c, o in zip(g, language._ODD)) + n) % 2**64], U64)
                out[int(mix(h)[0]) & (language.DIM - 1)] += 1
    return out


def test_language_scores_against_a_plain_version(spark):
    draw = np.random.default_rng(6)
    model = language.Model(["aa", "bb", "cc"], draw.normal(size=(language.DIM, 3)).astype(np.float32), draw.normal(size=3), 0.7)
    rows = [tuple(r) for r in spark.read.parquet(DOCS).select("doc_id", "text").where("length(text) < 2000").limit(40).collect()]
    rows += [(9000, None), (9001, "12 34"), (9002, "it's a-b c3d É x1y2 İx"), (9003, "ab ab ab")]
    got = {r.doc_id: r for r in language.predict_language(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        grams = plain_grams(text or "")
        if not grams:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        z = (sum(n * model.weights[f].astype(float) for f, n in grams.items()) / sum(grams.values()) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i].lang_pred == model.langs[int(p.argmax())] and got[i].score == pytest.approx(p.max(), abs=1e-6)


def test_rare_languages_and_the_sample(spark):
    """With more languages than the sample has places, the most frequent are learnt."""
    rows = [(i, f"text number {i} of many words", f"l{i % 7}") for i in range(70)] + [(100 + i, "again more text here", "l0") for i in range(5)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=5)
    assert len(model.langs) == 5 and "l0" in model.langs
