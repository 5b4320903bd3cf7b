"""Near-duplicate documents by SetSketch bands, joint estimates and exact confirmation.

1. One scan gives each text its shingle set's fingerprint, size and sketch.
2. Documents with equal sets become one class, so a group of thousands of copies
   costs one row from here on.
3. Sketches are cut into bands; a bucket is a band's value.  Each class is checked
   against the least member of the buckets it shares most (linear in the rows), and
   confirmed links are joined into components.
4. Only buckets that still hold several components are looked into: blocks of their
   members are compared by register in one task each, and pairs whose likelihood
   estimate may reach the limit are confirmed.
5. Confirmation is always on the whole sets.  Pairs are dealt to tiles of at most
   two blocks of documents, so a large group spreads over many tasks, and a set is
   sent once to a tile and not once for each pair.

Sets are read from the documents again, only for documents that share a bucket (a
bitmap of fixed size says which), so they are never stored for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import Scratch
from . import setsketch as S
from .textkernel import U64, Words, mix, map_texts, slices, words_of

SHINGLE = 5
#: Links need PERCENT per cent of the union in the intersection.
PERCENT = 75
#: Pairs estimated below this are not confirmed: 4.5 standard errors below the limit.
LEAST_ESTIMATE = 0.665
#: Documents of a block; two blocks meet in a tile.  Where all meet one leader, blocks are
#: smaller, as each costs but the leader's set.
BLOCK, LED_BLOCK = 128, 32
SKETCH_BLOCK = 512
#: Bits of the bitmap of documents whose sets are needed; one of 64 MB at most.
MOST_BITS = 1 << 29
#: Words of 32 bits of a bitmap that one row brings to the driver.
CHUNK = 1 << 14


def shingle_sets(words: Words, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles."""
    at, hashed = words.windows(size)
    where = np.searchsorted(at, words.first)
    for i in range(words.n):
        if words.count[i] >= size:
            h = np.sort(hashed[where[i] : where[i + 1]])
            yield h[np.concatenate(([True], h[1:] != h[:-1]))]
        elif words.count[i]:
            yield np.array([words.whole(i)], U64)
        else:
            yield np.zeros(0, U64)


def _sign(batches):
    recent: dict[tuple, bytes] = {}
    for batch in batches:
        for part in slices(batch):
            rows = []
            for s in shingle_sets(words_of(part.column("text"), lower=True)):
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                key = (int(mix(s).sum(dtype=U64)), int(mix(s ^ U64(0xD6E8FEB86659FD93)).sum(dtype=U64)))
                if key not in recent:
                    if len(recent) > 2000:
                        recent.clear()
                    recent[key] = S.sketch(s).tobytes()
                rows.append((len(s), *np.array(key, U64).view(np.int64).tolist(), recent[key]))
            n, a, b, r = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(r, pa.binary())], names=["doc_id", "n", "h1", "h2", "regs"])


def _where(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64)) & U64(bits - 1)).astype(np.int64)


def _wanted(df: DataFrame, scratch: Scratch) -> tuple[np.ndarray, int]:
    """A bitmap over hashed ``doc`` of df, of a size that follows their number up to MOST_BITS."""
    n = max(df.count(), 1)
    bits = min(MOST_BITS, 1 << (16 * n - 1).bit_length())

    def mark(batches):
        for b in batches:
            if b.num_rows:
                at = _where(b.column(0).to_numpy(zero_copy_only=False), bits)
                word, inverse = np.unique(at >> 5, return_inverse=True)
                value = np.zeros(len(word), np.int64)
                np.bitwise_or.at(value, inverse, np.int64(1) << (at & 31))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value)], names=["word", "bits"])

    def chunk(key, table):
        words = np.zeros(CHUNK, "<u4")
        words[table.column("word").to_numpy() % CHUNK] = table.column("bits").to_numpy().astype("<u4")
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([words.tobytes()], pa.binary())], names=["chunk", "words"])

    found = df.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = found.groupBy(F.floor(F.col("word") / CHUNK).cast("long").alias("chunk")).applyInArrow(chunk, "chunk long, words binary")
    out = np.zeros(max(bits >> 5, CHUNK), np.uint32)
    for at, words in zip(*found.toArrow().to_pydict().values(), strict=True):
        out[at * CHUNK : (at + 1) * CHUNK] = np.frombuffer(words, "<u4")
    return out, bits


def _sets_of(documents: DataFrame, wanted: np.ndarray, bits: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(wanted)  # of fixed size

    def read(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at = _where(ids, bits)
            keep = pa.array((shared.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool))
            for part in slices(batch.filter(keep)):
                sets = [s.tobytes() for s in shingle_sets(words_of(part.column("text"), lower=True))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["doc", "items"])

    return map_texts(documents.where("doc_id is not null").select("doc_id", "text"), read, "doc long, items binary")


def _block(doc: str, blocks: str) -> F.Column:
    return F.pmod(F.xxhash64(doc), F.col(blocks))


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirm(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    items: dict[int, set[bytes]] = {}  # a document has one set, or more if its id stands for several texts
    for d, s in zip(sets.column("doc").to_pylist(), sets.column("items").to_pylist(), strict=True):
        items.setdefault(d, set()).add(s)
    read = {d: [np.frombuffer(s, U64) for s in own if s] for d, own in items.items()}
    xs, ys = [], []
    for x, partners in zip(pairs.column("x").to_pylist(), pairs.column("ys").to_pylist(), strict=True):
        for y in partners:
            if any(_linked(a, b) for a in read.get(x, ()) for b in read.get(y, ())):
                xs.append(x)
                ys.append(y)
    return pa.table([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["src", "dst"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (src, dst) among ``pairs`` (fam, bx, by, x, ys): pairs of documents, dealt to
    tiles (fam, bx, by)."""
    need = pairs.select("fam", "bx", "by", F.explode(F.array_union(F.array("x"), "ys")).alias("doc")).distinct()
    dealt = need.join(sets, "doc").select(F.col("fam").alias("f"), F.col("bx").alias("i"), F.col("by").alias("j"), "doc", "items")
    return pairs.groupBy("fam", "bx", "by").cogroup(dealt.groupBy("f", "i", "j")).applyInArrow(_confirm, "src long, dst long")


def _look(table: pa.Table) -> pa.Table:
    """Pairs to confirm between the outsiders and the members of one block of a bucket."""
    band = table.column("band")[0].as_py()
    regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint8).reshape(-1, S.M)
    doc, n = table.column("doc").to_numpy(), table.column("n").to_numpy()
    comp, out = table.column("component").to_numpy(), table.column("out").to_numpy(zero_copy_only=False)
    a, b = np.flatnonzero(out), np.flatnonzero(~out)
    apart = comp[a][:, None] != comp[b][None, :]
    # where both are outsiders, each pair meets twice: the smaller document speaks
    odd = table.column("odd").to_numpy(zero_copy_only=False)
    apart &= ~odd[b][None, :] | (doc[a][:, None] < doc[b][None, :])
    i, j = S.pairs_to_confirm(regs[a], n[a], regs[b], n[b], apart, band, LEAST_ESTIMATE, PERCENT / 100)
    return pa.table([pa.array(doc[a][i], pa.int64()), pa.array(doc[b][j], pa.int64())], names=["x", "y"])


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents`` (doc_id, text, ...).

    Words are runs of characters but white space (space, U+0009 to U+000D), A-Z in
    lower case.  A text's set has its distinct five-word shingles, or with fewer words
    the whole sequence.  Documents are linked when 100 * intersection >= 75 * union.
    component_id is the smallest doc_id that links lead to, itself included; kept
    tells whether it is the document's own.

    Null or blank texts have an empty set and no links.  A row with a null doc_id is
    returned with a null component and kept, and links nothing.  Rows that repeat a
    doc_id are returned each, with the component of their own text; different texts with
    one least id count as one that links by either.  Ties cannot occur: least ids decide.
    Texts are read whole, however long.  No rows give none.  Other columns are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "neardup")
    signed = scratch.save(map_texts(documents.select("doc_id", "text"), _sign, "doc_id long, n long, h1 long, h2 long, regs binary"), "signed")
    linked = signed.where("n > 0 and doc_id is not null")
    classes = scratch.save(linked.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc")), "classes")
    heads = linked.join(classes, [linked.h1 == classes.h1, linked.h2 == classes.h2, linked.doc_id == classes.doc]).select(classes.h1, classes.h2, "doc", "n", "regs")
    heads = scratch.save(heads.dropDuplicates(["h1", "h2"]).drop("h1", "h2"), "heads")  # rows of a class are alike
    wide, signed = signed, scratch.save(signed.drop("regs"), "slim")
    scratch.drop(wide)

    cut = F.transform(F.sequence(F.lit(0), F.lit(S.BANDS - 1)), lambda k: F.substring("regs", k * S.ROWS + 1, F.lit(S.ROWS)))
    rows = heads.select("doc", F.posexplode(cut).alias("band", "value"))
    buckets = rows.groupBy("band", "value").agg(F.min("doc").alias("leader"), F.count("*").alias("size")).where("size > 1")
    shared = scratch.save(rows.join(scratch.save(buckets, "buckets"), ["band", "value"]), "shared")

    met = scratch.save(shared.select("doc").distinct(), "met")
    # the bitmap lets a few more pass, which costs less than a shuffle of all sets to drop them
    sets = scratch.save(_sets_of(documents, *_wanted(met, scratch)), "sets")

    # each document with the leader it shares most buckets with
    best = shared.where("doc <> leader").groupBy("doc", "leader").agg(F.count("*").alias("times"), F.max("size").alias("size"))
    best = best.groupBy("doc").agg(F.max(F.struct("times", -F.col("leader"), "size")).alias("b")).select("doc", (-F.col("b.col2")).alias("leader"), F.ceil(F.col("b.size") / LED_BLOCK).alias("blocks"))
    first = best.select(F.col("leader").alias("fam"), _block("doc", "blocks").alias("bx"), F.lit(-1).cast("long").alias("by"), F.col("doc").alias("x"), F.array("leader").alias("ys"))
    links = scratch.save(confirm(scratch.save(first, "first"), sets), "links")
    labels = connected_components(links, scratch, small=0)  # alike at every size

    # buckets with several components
    member = shared.join(labels.withColumnRenamed("vertex", "doc"), "doc", "left").select("band", "value", "doc", "size", F.coalesce("component", "doc").alias("component"))
    member = scratch.save(member, "member")
    per = member.groupBy("band", "value", "component").agg(F.count("*").alias("c"))
    mixed = per.groupBy("band", "value").agg(F.count("*").alias("components"), F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("all")).where("components > 1")
    mixed = scratch.save(mixed.select("band", "value", F.col("main.component").alias("main"), (F.col("all") - F.col("main.c")).alias("outsiders")), "mixed")
    odd = member.join(mixed, ["band", "value"]).select("band", "value", "doc", "size", "outsiders", "component", (F.col("component") != F.col("main")).alias("odd"))
    odd = odd.join(heads, "doc").withColumn("blocks", F.ceil(F.col("size") / SKETCH_BLOCK)).withColumn("out_blocks", F.ceil(F.col("outsiders") / SKETCH_BLOCK))
    # outsiders have blocks of their own, so a member is copied once for each of those only
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = odd.withColumn("bx", every("out_blocks")).withColumn("by", _block("doc", "blocks")).withColumn("out", F.lit(False))
    asks = odd.where("odd").withColumn("bx", _block("doc", "out_blocks")).withColumn("by", every("blocks")).withColumn("out", F.lit(True))
    columns = ["band", "value", "bx", "by", "doc", "n", "component", "odd", "out", "regs"]
    found = asked.select(columns).union(asks.select(columns)).groupBy("band", "value", "bx", "by").applyInArrow(_look, "x long, y long")
    found = scratch.save(found, "found")

    # those estimated close enough, in families of documents that hang together
    family = connected_components(found.select(F.col("x").alias("src"), F.col("y").alias("dst")), scratch, small=0)
    family = family.join(family.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "component")
    family = scratch.save(family.select(F.col("vertex"), F.col("component").alias("fam"), _block("vertex", "blocks").alias("b")), "family")
    fx = family.select(F.col("vertex").alias("x"), "fam", F.col("b").alias("bx"))
    fy = family.select(F.col("vertex").alias("y"), F.col("b").alias("by"))
    second = found.join(fx, "x").join(fy, "y").groupBy("fam", "bx", "by", "x").agg(F.collect_set("y").alias("ys"))
    more = scratch.save(confirm(scratch.save(second, "second"), sets), "more")
    # components of components
    to = labels.select(F.col("vertex"), "component")
    joins = more.join(to.select(F.col("vertex").alias("src"), F.struct("component").alias("s")), "src", "left").join(to.select(F.col("vertex").alias("dst"), F.struct("component").alias("d")), "dst", "left")
    joins = joins.select(F.coalesce("s.component", "src").alias("src"), F.coalesce("d.component", "dst").alias("dst"))
    upper = connected_components(joins.union(labels.select(F.col("component"), F.col("component"))), scratch, small=0)
    label = labels.join(upper.select(F.col("vertex").alias("component"), F.col("component").alias("final")), "component", "left").select(F.col("vertex").alias("doc"), F.coalesce("final", "component").alias("component"))
    label = label.union(upper.join(labels, "vertex", "left_anti").select("vertex", "component")).distinct()
    known = classes.join(label, "doc", "left").select("h1", "h2", F.coalesce("component", "doc").alias("component"))
    known = scratch.save(known, "known")
    scratch.drop(shared, met, sets, heads, member)
    out = signed.select("doc_id", "n", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
