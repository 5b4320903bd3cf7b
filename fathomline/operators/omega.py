"""Solvers over whole graphs, with what code outside the modules may do.

Both give one shape of answer, ``Solved``: what each value may point at, which values
may be addresses from outside, which objects code outside knows, and the functions
that each indirect call reaches.  An answer that nothing proves empty is unknown.

The inclusion solver takes code outside for one more value per module, ``val:leaked``,
that holds what leaked and reads and moves it, and for an object, ``obj:outside``, that
stands for all unknown memory.  The unification solver joins classes first and then
carries two bits over them, as joining what leaked would make one class of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import signatures_fit
from ..runtime import Scratch
from .components import connected_components
from .lowering import OBJECTS, Graph, Program, union
from .points_to import CELL, solve_inclusion


@dataclass
class Solved:
    points: DataFrame  # (node, set): values of one set point at the same objects
    members: DataFrame  # (set, obj)
    outside: DataFrame  # (node): may be an address that the module knows nothing of
    escaped: DataFrame  # (obj)
    targets: DataFrame  # (site, obj): functions that an indirect call reaches
    open_sites: DataFrame  # (site): indirect calls that may also reach functions outside


def proven_empty(g: Graph, scratch: Scratch) -> DataFrame:
    """(id): values that are null, or take only such values."""
    flows = g.edges.where("kind = 'assign'").select("src", F.col("dst").alias("id"))
    others = g.edges.where("kind not in ('assign', 'store', 'memcpy')").select(F.col("dst").alias("id"))
    marked = g.marks.where("mark = 'outside'").select(F.col("node").alias("id"))
    start = g.nodes.where("empty").select("id").join(others.union(marked).union(flows.select("id")), "id", "left_anti")
    seen = new = scratch.save(start.distinct(), "empty")
    total = flows.distinct().groupBy("id").agg(F.count("*").alias("n"))
    while not new.isEmpty():
        known = flows.distinct().join(seen.withColumnRenamed("id", "src"), "src", "left_semi").groupBy("id").agg(F.count("*").alias("k"))
        found = known.join(total, "id").where("n = k").select("id").join(others.union(marked), "id", "left_anti")
        new = scratch.save(found.join(seen, "id", "left_anti").distinct(), "new")
        seen = scratch.grow(seen, new, "empty")
    return seen


def constraints(g: Graph, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(kind, src, dst, off, site) that solvers take, copies as loads and stores still to come, and
    marks (mark, node): only ends that may carry addresses, and none that is proven empty."""
    empty = proven_empty(g, scratch)
    n = g.nodes.select("id", "carries").join(empty.withColumn("none", F.lit(True)), "id", "left").withColumn("none", F.coalesce("none", F.lit(False)))
    n = scratch.save(n, "carriers")
    end = lambda c: n.select(F.col("id").alias(c), F.col("carries").alias(f"{c}_carries"), F.col("none").alias(f"{c}_none"))
    e = g.edges.join(end("src"), "src").join(end("dst"), "dst")
    carried = F.when(F.col("kind") == "assign", F.col("src_carries") & F.col("dst_carries")).when(F.col("kind") == "load", F.col("dst_carries")).when(F.col("kind") == "store", F.col("src_carries")).otherwise(True)
    written = ~(F.col("kind").isin("store", "memcpy") & F.col("dst_none"))
    e = scratch.save(e.where(carried & written), "carried")
    # a lane may be anywhere; of a copy it is the length
    off = F.when(F.col("kind") == "memcpy", F.col("width").cast("long")).when(F.col("modulus").isNull(), F.col("off"))
    plain = e.where("not src_none or kind = 'addr_of'").select("kind", "src", "dst", off.alias("off"))
    # what is read or moved from nothing is unknown
    lost = e.where("src_none and kind in ('load', 'gep')").select(F.lit("outside").alias("mark"), F.col("dst").alias("node"))
    lost = lost.union(e.where("src_none and kind = 'memcpy'").select(F.lit("payload").alias("mark"), F.col("dst").alias("node")))
    marks = g.marks.select("mark", "node").join(empty.withColumnRenamed("id", "node"), "node", "left_anti").union(lost.select("node", "mark")).select("mark", "node").distinct()
    return scratch.save(plain.distinct(), "plain"), scratch.save(marks, "marks")


@dataclass
class Calls:
    """Indirect sites and functions by number, and their arguments and results by node."""

    sites: DataFrame  # site, operand, cc, ret, params, module, key
    functions: DataFrame  # obj, cc, ret, params, external, address_taken
    args: DataFrame  # site, pos, node
    results: DataFrame  # site, node
    params: DataFrame  # obj, pos, node
    returns: DataFrame  # obj, node


def calls_of(p: Program, g: Graph, scratch: Scratch) -> Calls:
    id_ = lambda label, out: g.nodes.where(F.col("label").startswith(label)).select("module", F.col("label").alias("label"), F.col("id").alias(out))
    s = g.sites.where("kind = 'call_indirect'")
    s = s.withColumn("label", F.concat(F.lit("site:"), "site")).join(id_("site:", "number"), ["module", "label"]).drop("label")
    s = scratch.save(s, "indirect")
    f = p.functions.withColumn("label", F.concat(F.lit("obj:function:"), "key")).join(id_("obj:function:", "obj"), ["module", "label"]).drop("label")
    f = scratch.save(f, "callable")
    pos = F.explode(F.when(F.col("nparams") > 0, F.sequence(F.lit(0), F.col("nparams") - 1)).otherwise(F.array().cast("array<int>")))
    params = f.select("module", "obj", "key", pos.alias("pos")).withColumn("label", F.concat_ws(":", F.lit("param"), "key", F.col("pos").cast("string"))).join(id_("param:", "node"), ["module", "label"]).select("obj", "pos", "node")
    returns = f.select("module", "obj", F.concat(F.lit("ret:"), "key").alias("label")).join(id_("ret:", "node"), ["module", "label"]).select("obj", "node")
    return Calls(
        s.select(F.col("number").alias("site"), "operand", "cc", "ret", "params", "module", F.col("site").alias("key")),
        f.select("obj", "cc", "ret", "params", "external", "address_taken", "module", "key"),
        scratch.save(s.select(F.col("number").alias("site"), F.posexplode("args_id").alias("pos", "node")), "args"),
        scratch.save(s.where("result is not null").select(F.col("number").alias("site"), F.col("result").alias("node")), "results"),
        scratch.save(params, "params"), scratch.save(returns, "returns"),
    )


def _omega(g: Graph) -> DataFrame:
    """(module, ext, val, leaked): each module's nodes for code outside."""
    w = g.nodes.where("label in ('obj:outside', 'val:outside', 'val:leaked')")
    pick = lambda label: F.max(F.when(F.col("label") == label, F.col("id")))
    return w.groupBy("module").agg(pick("obj:outside").alias("ext"), pick("val:outside").alias("val"), pick("val:leaked").alias("leaked"))


def solve_by_inclusion(p: Program, g: Graph, scratch: Scratch, fields: bool = True) -> Solved:
    """Inclusion, with the call graph found along with it."""
    plain, marks = constraints(g, scratch)
    calls = calls_of(p, g, scratch)
    w = scratch.save(_omega(g), "omega")
    owner = g.nodes.select(F.col("id").alias("node"), "module").join(w, "module")
    m = scratch.save(marks.join(owner, "node"), "owned-marks")
    row = lambda d, kind, src, dst: d.select(F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(None).cast("long").alias("off"))
    outer = [
        row(m.where("mark = 'outside'"), "assign", "val", "node"), row(m.where("mark = 'leaks'"), "assign", "node", "leaked"),
        row(m.where("mark = 'escaped'"), "addr_of", "node", "leaked"), row(m.where("mark = 'payload'"), "store", "val", "node"),
        row(w, "addr_of", "ext", "val"), row(w, "addr_of", "ext", "leaked"), row(w, "load", "leaked", "leaked"), row(w, "store", "val", "leaked"), row(w, "gep", "leaked", "leaked"), row(w, "gep", "val", "val"),
    ]
    edges = union([plain, *outer]).distinct()
    if fields:  # an object that holds another's address is its first cell
        edges = edges.withColumn("dst", F.when(F.col("dst") >= OBJECTS, F.col("dst") * CELL).otherwise(F.col("dst")))
    edges = scratch.save(edges, "constraints")
    nothing = F.lit("").alias
    sites = calls.sites.select("site", "operand", "cc", "ret", "params", F.lit(False).alias("any"))
    sites = sites.union(w.select((-F.col("leaked") - 1).alias("site"), "leaked", nothing("cc"), nothing("ret"), nothing("params"), F.lit(True)))
    functions = calls.functions.select("obj", F.col("obj").alias("fid"), "cc", "ret", "params", F.lit(False).alias("any"))
    functions = functions.union(w.select("ext", "ext", nothing("cc"), nothing("ret"), nothing("params"), F.lit(True)))
    sites, functions = scratch.save(sites, "asked"), scratch.save(functions, "named")
    known = calls.functions.select(F.col("obj").alias("fid"), "external", "module")
    at = scratch.save(calls.sites.select("site", "module").join(w.select("module", "val", "leaked"), "module").drop("module"), "site-omega")

    def bind(hit: DataFrame) -> DataFrame:
        """What each pair of a site and a function copies; a function outside takes all and gives anything."""
        named = hit.join(known, "fid", "left")
        inner = named.where("external = false").join(at.select("site"), "site", "left_semi")
        formal = calls.params.select(F.col("obj").alias("fid"), "pos", F.col("node").alias("dst"))
        passed = inner.join(calls.args, "site").withColumnRenamed("node", "src").join(formal, ["fid", "pos"]).select("src", "dst")
        given = inner.join(calls.returns.select(F.col("obj").alias("fid"), F.col("node").alias("src")), "fid").join(calls.results.withColumnRenamed("node", "dst"), "site").select("src", "dst")
        outer = named.where("external is null or external").join(at, "site")
        taken = outer.join(calls.args, "site").select(F.col("node").alias("src"), F.col("leaked").alias("dst"))
        any_ = outer.join(calls.results, "site").select(F.col("val").alias("src"), F.col("node").alias("dst"))
        # code outside calls a function that it knows
        called = named.where("external = false").join(w.withColumn("site", -F.col("leaked") - 1).select("site", "val", "leaked"), "site")
        fed = called.join(formal, "fid").select(F.col("val").alias("src"), "dst")
        told = called.join(calls.returns.select(F.col("obj").alias("fid"), F.col("node").alias("src")), "fid").select("src", F.col("leaked").alias("dst"))
        return union([passed, given, taken, any_, fed, told])

    pts, hits = solve_inclusion(edges, scratch, fields=fields, calls=(sites, functions, bind))
    if fields:
        cells = pts.select(F.when(F.col("node") >= (1 << 47), F.floor(F.col("node") / CELL)).otherwise(F.col("node")).cast("long").alias("node"), F.floor(F.col("obj") / CELL).cast("long").alias("obj"))
        pts = cells.distinct()
    pts = scratch.save(pts, "points-to")
    ext = w.select(F.col("ext").alias("obj"))
    outside = pts.join(ext, "obj", "left_semi").select("node").distinct()
    escaped = pts.join(w.select(F.col("leaked").alias("node")), "node", "left_semi").select("obj").distinct().join(ext, "obj", "left_anti")
    members = pts.join(ext, "obj", "left_anti").select(F.col("node").alias("set"), "obj")
    targets = hits.join(calls.sites.select("site"), "site", "left_semi").join(calls.functions.select(F.col("obj").alias("fid")), "fid", "left_semi").select("site", F.col("fid").alias("obj"))
    outside = scratch.save(outside, "outside")
    open_sites = calls.sites.select("site", F.col("operand").alias("node")).join(outside, "node", "left_semi").select("site")
    return Solved(pts.select("node", F.col("node").alias("set")).distinct(), scratch.save(members, "members"), outside, scratch.save(escaped, "escaped"), scratch.save(targets.distinct(), "targets"), open_sites)


def solve_by_unification(p: Program, g: Graph, scratch: Scratch) -> Solved:
    """Unification: classes of values and of what they point at, with calls joined as they are found,
    and then the bits ``outside`` and ``escaped`` carried over the classes."""
    plain, marks = constraints(g, scratch)
    calls = calls_of(p, g, scratch)
    labels, hits = _classes(plain, g, calls, scratch)
    own = scratch.save(labels.where("vertex % 4 = 0").select(F.floor(F.col("vertex") / 4).cast("long").alias("node"), F.col("component").alias("class")), "class-of")
    star = scratch.save(labels.where("vertex % 4 = 1").select(F.floor(F.col("vertex") / 4).cast("long").alias("node"), F.col("component").alias("star")), "star-of")
    after = labels.select((F.col("vertex") - 1).alias("vertex"), F.col("component").alias("star"))
    next_ = labels.where("vertex % 4 < 2").join(after, "vertex").select(F.col("component").alias("class"), "star")
    next_ = scratch.save(next_.distinct(), "next")

    # bits by class: 2 * class is outside, 2 * class + 1 escaped
    bit = lambda c, k: (F.col(c) * 2 + k)
    cls = lambda c, out: own.select(F.col("node").alias(c), F.col("class").alias(out))
    pte = lambda c, out: star.select(F.col("node").alias(c), F.col("star").alias(out))
    step = lambda d, a, i, b, j: d.select(bit(a, i).alias("src"), bit(b, j).alias("dst"))
    load = plain.where("kind = 'load'").join(pte("src", "a"), "src").join(cls("dst", "b"), "dst")
    store = plain.where("kind = 'store'").join(cls("src", "a"), "src").join(pte("dst", "b"), "dst")
    copy = plain.where("kind = 'memcpy'").join(pte("src", "a"), "src").join(pte("dst", "b"), "dst")
    steps = [step(d, "a", i, "b", 0) for d in (load, store, copy) for i in (0, 1)] + [step(next_, "class", i, "star", j) for i in (0, 1) for j in (0, 1)]
    # code outside calls functions that it knows, and a call of an unknown function leaks its arguments
    f = calls.functions.select("obj").join(cls("obj", "a"), "obj")
    steps.append(step(f.join(calls.params, "obj").join(cls("node", "b"), "node"), "a", 1, "b", 0))
    steps.append(step(f.join(calls.returns, "obj").join(pte("node", "b"), "node"), "a", 1, "b", 1))
    s = calls.sites.select("site", "operand").join(pte("operand", "a"), "operand")
    s_args, s_results = s.join(calls.args, "site").join(pte("node", "b"), "node"), s.join(calls.results, "site").join(cls("node", "b"), "node")
    steps += [step(s_args, "a", 0, "b", 1), step(s_results, "a", 0, "b", 0)]
    steps = scratch.save(union(steps).where("src <> dst").distinct(), "bit-steps")
    start = [
        marks.where("mark = 'outside'").join(cls("node", "c"), "node").select(bit("c", 0).alias("node")), marks.where("mark = 'leaks'").join(pte("node", "c"), "node").select(bit("c", 1)),
        marks.where("mark = 'escaped'").join(cls("node", "c"), "node").select(bit("c", 1)), marks.where("mark = 'payload'").join(pte("node", "c"), "node").select(bit("c", 0)),
    ]
    external = hits.join(calls.functions.where("external").select("obj"), "obj", "left_semi").select("site")
    start += [external.join(calls.args, "site").join(pte("node", "c"), "node").select(bit("c", 1)), external.join(calls.results, "site").join(cls("node", "c"), "node").select(bit("c", 0))]
    start = start[0].union(start[1]).union(start[2]).union(start[3]).union(start[4]).union(start[5])
    seen = new = scratch.save(start.distinct(), "bits")
    follow = steps.select(F.col("src").alias("node"), "dst")
    while not new.isEmpty():
        found = new.join(follow, "node").select(F.col("dst").alias("node")).distinct()
        new = scratch.save(found.join(seen, "node", "left_anti"), "new")
        seen = scratch.grow(seen, new, "bits")
    bits = scratch.save(seen.select(F.floor(F.col("node") / 2).cast("long").alias("class"), (F.col("node") % 2).alias("bit")), "bits-of")
    outside = own.join(bits.where("bit = 0"), "class", "left_semi").select("node")
    objects = g.nodes.where("label like 'obj:%'").select(F.col("id").alias("obj"))
    escaped = own.join(bits.where("bit = 1"), "class", "left_semi").select(F.col("node").alias("obj")).join(objects, "obj", "left_semi")
    members = own.withColumnRenamed("node", "obj").join(objects, "obj", "left_semi").select(F.col("class").alias("set"), "obj")
    # what an operand points at may be outside without the operand's own class being so
    open_sites = s.join(bits.where("bit = 0").select(F.col("class").alias("a")), "a", "left_semi").select("site")
    return Solved(star.select("node", F.col("star").alias("set")), scratch.save(members, "members"), scratch.save(outside, "outside"), scratch.save(escaped, "escaped"), scratch.save(hits.select("site", "obj").distinct(), "targets"), scratch.save(open_sites, "open-sites"))


def _classes(plain: DataFrame, g: Graph, calls: Calls, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(vertex, component) of all terms (4 * node + dereferences), and (site, obj) that calls reach.

    Each round makes what equal terms point at equal, for the classes that hold several
    stars only, and joins the arguments and results of newly reached functions.
    """
    term = lambda c, k: (F.col(c) * 4 + k)
    rule = {"assign": (0, 0), "gep": (0, 0), "addr_of": (0, 1), "load": (2, 1), "store": (1, 2), "memcpy": (2, 2)}
    equal = union([plain.where(F.col("kind") == k).select(term("src", s).alias("src"), term("dst", d).alias("dst")) for k, (s, d) in rule.items()])
    terms = g.nodes.select(F.explode(F.array(*[term("id", k) for k in range(3)])).alias("src"))
    labels = connected_components(equal.union(terms.select("src", F.col("src").alias("dst"))), scratch)
    functions = calls.functions.select("obj", F.col("cc").alias("fcc"), F.col("ret").alias("fret"), F.col("params").alias("fparams"))
    hits = None
    while True:
        stars = labels.where("vertex % 4 < 2").select("component", (F.col("vertex") + 1).alias("vertex")).join(labels.withColumnRenamed("component", "to"), "vertex").select("component", "to").distinct()
        least = stars.groupBy("component").agg(F.min("to").alias("least"), F.count("*").alias("n")).where("n > 1")
        new = scratch.save(stars.join(least, "component").where("to <> least").select(F.col("to").alias("src"), F.col("least").alias("dst")).distinct(), "merge")
        if new.isEmpty():
            star = labels.where("vertex % 4 = 1").select(F.floor(F.col("vertex") / 4).cast("long").alias("operand"), F.col("component").alias("class"))
            own = labels.where("vertex % 4 = 0").select(F.floor(F.col("vertex") / 4).cast("long").alias("obj"), F.col("component").alias("class"))
            asked = calls.sites.select("site", "operand", "cc", "ret", "params").join(star, "operand")
            hit = asked.join(functions.join(own, "obj"), "class").where((F.col("cc") == F.col("fcc")) & signatures_fit("ret", "params", "fret", "fparams")).select("site", "obj").distinct()
            hit = scratch.save(hit if hits is None else hit.join(hits, ["site", "obj"], "left_anti"), "hit")
            hits = hit if hits is None else scratch.grow(hits, hit, "hits")
            passed = hit.join(calls.args, "site").withColumnRenamed("node", "a").join(calls.params, ["obj", "pos"]).select(term("a", 0).alias("a"), term("node", 0).alias("b"))
            given = hit.join(calls.returns.withColumnRenamed("node", "a"), "obj").join(calls.results, "site").select(term("a", 0), term("node", 0))
            name = lambda c, out: labels.select(F.col("vertex").alias(c), F.col("component").alias(out))
            bound = passed.union(given).join(name("a", "src"), "a").join(name("b", "dst"), "b").where("src <> dst").select("src", "dst").distinct()
            new = scratch.save(bound, "bound")
            if new.isEmpty():
                return labels, hits
        joined = connected_components(new, scratch).select(F.col("vertex").alias("component"), F.col("component").alias("to"))
        labels = scratch.save(labels.join(joined, "component", "left").select("vertex", F.coalesce("to", "component").alias("component")), "labels")
