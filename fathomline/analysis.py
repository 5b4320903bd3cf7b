"""Whole-program analysis from program files to exports: ``analyze(spark, path, options)``.

All modules of a path are analysed together, each for itself: every table has the
module as a column, and nothing flows from one to another.  The stages answer ever more
finely: ``conservative`` takes every address-taken function whose signature fits,
``steens`` unifies, ``andersen`` includes.  What is unknown has a row of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.predicates import ignored_global, signatures_fit
from .operators import derive as D
from .operators import omega
from .operators.components import connected_components
from .operators.graph import reachable
from .operators.lowering import INIT, Graph, Options, Program, build, positional, program, union
from .operators.modref import transitive
from .runtime import Scratch
from .sources import sinks
from .sources.contracts import contracts
from .sources.pir import read_pir

OUTSIDE_CALLER, OUTSIDE_CALLEE = "address_escapes_to_external", "omega_fnptr"
#: Names whose calls leave the modelled control flow.  Fixed values.
BOUNDARY_CALLS = {"dlopen": "dlopen_dlsym", "dlsym": "dlopen_dlsym", "setjmp": "setjmp_longjmp", "longjmp": "setjmp_longjmp"}
#: The order of each export's rows.
ORDER = {
    "functions": ["module", "key"], "globals": ["module", "key"], "callgraph": ["module", "caller", "callsite", "callee", "kind", "tier"], "modref": ["module", "func", "global", "access", "via", "witness"],
    "transitive": ["module", "func", "global", "access", "via"], "stationarity": ["module", "global"], "components": ["module", "id"], "audit": ["module", "kind", "at", "affected"], "metrics": ["module"],
}


@dataclass
class Analysis:
    """Tables by name; see ORDER for the names."""

    options: Options
    tables: dict[str, DataFrame] = field(default_factory=dict)
    graph: Graph | None = None
    solved: omega.Solved | None = None

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def export(self, folder: str) -> None:
        """Each table as sorted JSON lines under ``folder``."""
        for name, table in self.tables.items():
            sinks.write_jsonl(table, f"{folder}/{name}.jsonl", ORDER[name])


def analyze(spark: SparkSession, source: str | DataFrame, options: Options = Options()) -> Analysis:
    """The analysis of the program files under ``source`` (a path, or modules as ``read_pir`` gives them).

    Modules are told apart by name.  A module without functions or globals gives no
    rows; a callee that no module declares is an external one.  Repeated modules, or
    keys within one, are an error of the input and are reported as one.
    """
    scratch = Scratch(spark, "analysis")
    modules = scratch.save(read_pir(spark, source, multiline=True) if isinstance(source, str) else source, "modules")
    p = program(modules, options, scratch)
    twice = union([t.groupBy("module", "key").count().where("count > 1").select("module", "key") for t in (p.functions, p.globals)]).first()
    if twice:
        raise ValueError(f"{twice['key']} is declared twice in module {twice['module']}")
    out = Analysis(options)
    g = out.graph = build(p, contracts(spark), options, scratch)
    solved = None
    if options.stage == "andersen":
        solved = omega.solve_by_inclusion(p, g, scratch, options.fields)
    elif options.stage == "steens":
        solved = omega.solve_by_unification(p, g, scratch)
    out.solved = solved
    ids = g.nodes.select("module", "label", "id")
    globals_ = p.globals.where(~ignored_client(F.col("key"))).withColumn("label", F.concat(F.lit("obj:global:"), "key")).join(ids, ["module", "label"]).drop("label")
    globals_ = scratch.save(globals_, "client-globals")

    places = scratch.save(origins(g, scratch), "places")
    edges = call_edges(p, g, solved, options, scratch, places)
    rows = modref(p, g, globals_, solved, options, scratch)
    wrote = scratch.save(global_state(g, globals_, solved, rows, scratch), "global-state")
    verdicts = scratch.save(stationarity(p, g, globals_, wrote, solved, rows, places, options), "verdicts")
    if solved is not None and options.exact:
        edges = initval_edges(edges, p, g, globals_, verdicts, places, options)
    edges = scratch.save(edges.distinct(), "call-edges")
    findings = scratch.save(audits(p, g, solved, scratch), "audit")
    parts = components(p, globals_, wrote, verdicts, edges, rows, findings, scratch)
    out.tables = {
        "functions": functions_table(p, g, solved),
        "globals": globals_table(globals_, wrote, verdicts),
        "callgraph": edges,
        "modref": rows,
        "transitive": transitive_rows(edges, rows, scratch),
        "stationarity": verdicts,
        "components": parts,
        "audit": findings,
        "metrics": metrics(p, g, globals_, edges, rows, parts, wrote),
    }
    return out


def ignored_client(key):
    return F.regexp_replace(key, "^@", "").rlike(r"^(\.str|__PRETTY_FUNCTION__|__const)") | ignored_global(key)


def _objects(g: Graph, sort: str) -> DataFrame:
    """(module, key, id) of the objects of a sort."""
    head = f"obj:{sort}:"
    return g.nodes.where(F.col("label").startswith(head)).select("module", F.substr("label", F.lit(len(head) + 1)).alias("key"), "id")


# ---- calls


def _edge(frame: DataFrame, caller, callsite, callee, kind: str, tier, caller_unknown=None, callee_unknown=None) -> DataFrame:
    none = F.lit(None).cast("string")
    pick = lambda c: none if c is None else F.col(c) if isinstance(c, str) else c
    return frame.select("module", pick(caller).alias("caller"), pick(caller_unknown).alias("caller_unknown"), pick(callsite).alias("callsite"), pick(callee).alias("callee"), pick(callee_unknown).alias("callee_unknown"), F.lit(kind).alias("kind"), (F.lit(tier) if isinstance(tier, str) else tier).alias("tier"))


def call_edges(p: Program, g: Graph, solved: omega.Solved | None, options: Options, scratch: Scratch, places: DataFrame) -> DataFrame:
    """Direct calls; indirect ones by stage, with an unknown callee where the answer may be more or
    is empty; and callers outside of functions that code outside knows."""
    known = p.functions.select("module", F.col("key").alias("callee"), F.lit(True).alias("known"))
    direct = g.sites.where("kind = 'call_direct'").join(known, ["module", "callee"], "left")
    rows = [_edge(direct.where("known"), "caller", "site", "callee", "direct", "direct"), _edge(direct.where("known is null"), "caller", "site", None, "direct", "direct", callee_unknown=F.lit("external_callee"))]
    sites = g.sites.where("kind = 'call_indirect'")
    taken = p.functions.where("address_taken").select("module", F.col("key").alias("callee"), F.col("cc").alias("fcc"), F.col("ret").alias("fret"), F.col("params").alias("fparams"))
    if solved is None:
        fits = sites.drop("callee").join(taken, "module").where((F.col("cc") == F.col("fcc")) & signatures_fit("ret", "params", "fret", "fparams"))
        rows += [_edge(fits, "caller", "site", "callee", "indirect", "fsa"), _edge(sites, "caller", "site", None, "indirect", "fsa", callee_unknown=F.lit(OUTSIDE_CALLEE))]
        rows.append(_edge(p.functions.where("address_taken or exported or external"), None, None, "key", "direct", "fsa", caller_unknown=F.lit(OUTSIDE_CALLER)))
        return union(rows)
    tier = options.stage
    numbered = sites.join(g.nodes.where("label like 'site:%'").select("module", F.substr("label", F.lit(6)).alias("site"), F.col("id").alias("number")), ["module", "site"])
    found = solved.targets.withColumnRenamed("site", "number").join(_objects(g, "function").select(F.col("key").alias("callee"), F.col("id").alias("obj")), "obj")
    found = numbered.drop("callee").join(found, "number").join(taken.select("module", "callee"), ["module", "callee"], "left_semi")
    exact = None
    if options.exact:
        exact = scratch.save(simple_targets(p, g, scratch, options.context_depth), "simple")
        found = found.join(exact.select("module", "site").distinct(), ["module", "site"], "left_anti")
        rows.append(_edge(numbered.drop("callee").join(exact, ["module", "site"]), "caller", "site", "callee", "indirect", "b2_simple"))
    found = scratch.save(found.select("module", "caller", "site", "callee").distinct(), "indirect")
    open_ = numbered.join(solved.open_sites.withColumnRenamed("site", "number").withColumn("open", F.lit(True)), "number", "left")
    open_ = open_.join(found.select("module", "site").distinct().withColumn("some", F.lit(True)), ["module", "site"], "left").where("open or some is null")
    if exact is not None:
        open_ = open_.join(exact.select("module", "site").distinct(), ["module", "site"], "left_anti")
    rows += [_edge(found, "caller", "site", "callee", "indirect", tier), _edge(open_, "caller", "site", None, "indirect", tier, callee_unknown=F.lit(OUTSIDE_CALLEE))]
    known = solved.escaped.join(_objects(g, "function").withColumnRenamed("id", "obj"), "obj")
    rows.append(_edge(known, None, None, "key", "direct", tier, caller_unknown=F.lit(OUTSIDE_CALLER)))
    return union(rows)


def simple_targets(p: Program, g: Graph, scratch: Scratch, depth: int) -> DataFrame:
    """(module, site, callee): calls whose operand takes its value from functions' names alone, over
    copies, parameters of functions that only known direct calls reach, results, and globals
    whose address is never taken, exported or moved."""
    e = g.edges.select("module", "kind", "src", "dst", "owner")
    label = g.nodes.select(F.col("id").alias("node"), "label", "module")
    addr = e.where("kind = 'addr_of'").select(F.col("src").alias("obj"), F.col("dst").alias("node"))
    sources = addr.join(label.where("label like 'obj:function:%'").select(F.col("node").alias("obj")), "obj").select("node", F.col("obj").alias("fid"))
    # globals that are only loaded from and stored to by name are slots
    named = addr.join(_objects(g, "global").join(p.globals.where("not exported and is_definition").select("module", "key"), ["module", "key"], "left_semi").select(F.col("id").alias("obj")), "obj")
    used = union([e.where("kind not in ('load', 'addr_of')").select(F.col("src").alias("node")), e.where("kind in ('memcpy')").select(F.col("dst").alias("node")), g.marks.select("node"), g.sites.where("kind = 'call_indirect'").select(F.explode("args_id").alias("node"))]).distinct()
    slots = scratch.save(named.join(used, "node", "left_anti"), "slots")
    into = e.where("kind = 'store'").join(slots.select(F.col("node").alias("dst"), "obj"), "dst").select("src", F.col("obj").alias("dst"), F.lit(True).alias("plain"))
    out = e.where("kind = 'load'").join(slots.select(F.col("node").alias("src"), "obj"), "src").select(F.col("obj").alias("src"), "dst", F.lit(True).alias("plain"))
    copies = e.where("kind = 'assign'").select("src", "dst", F.lit(True).alias("plain"))
    # all else that gives a value, and parameters that other callers may give
    odd = e.where("kind in ('load', 'gep')").select("src", "dst").join(out.select("src", "dst").withColumnRenamed("src", "s").drop("s"), "dst", "left_anti")
    loose = p.functions.where("address_taken or exported or external").select("module", "key", F.explode(F.when(F.col("nparams") > 0, F.sequence(F.lit(0), F.col("nparams") - 1)).otherwise(F.array().cast("array<int>"))).alias("pos"))
    loose = loose.select("module", F.concat_ws(":", F.lit("param"), "key", F.col("pos").cast("string")).alias("label")).join(label, ["module", "label"]).select(F.col("node").alias("src"), F.col("node").alias("dst"))
    marked = g.marks.where("mark in ('outside', 'payload')").select(F.col("node").alias("src"), F.col("node").alias("dst"))
    moved = e.where("kind = 'memcpy' or kind = 'addr_of'").join(sources.select(F.col("node").alias("dst"), F.lit(1).alias("fn")).distinct(), "dst", "left").where("fn is null").select("src", "dst")
    flows = union([copies, into, out, union([odd, loose, marked, moved]).withColumn("plain", F.lit(False))])
    sites = g.nodes.where("label like 'site:%'").select("module", F.substr("label", F.lit(6)).alias("key"), F.col("id").alias("site"))
    asked = g.sites.where("kind = 'call_indirect'").select("module", F.col("site").alias("key"), F.col("operand").alias("node"), "cc", "ret", "params").join(sites, ["module", "key"])
    asked = scratch.save(asked, "asked-simple")
    found = D.simple_sources(asked.select("site", "node"), sources, flows, scratch, depth).where("complete")
    f = p.functions.where("address_taken").join(_objects(g, "function"), ["module", "key"]).select(F.col("id").alias("fid"), F.col("key").alias("callee"), F.col("cc").alias("fcc"), F.col("ret").alias("fret"), F.col("params").alias("fparams"))
    fits = found.join(asked, "site").join(f, "fid").where((F.col("cc") == F.col("fcc")) & signatures_fit("ret", "params", "fret", "fparams"))
    return fits.select("module", F.col("key").alias("site"), "callee").distinct()


def origins(g: Graph, scratch: Scratch) -> DataFrame:
    """(node, obj, off): values with one producer each on the way from an object's name, and their place
    in it; off is null where it is not known."""
    e = g.edges.where("kind in ('addr_of', 'assign', 'gep', 'load')").select("kind", "src", "dst", "off", "modulus")
    outside = g.marks.where("mark = 'outside'").select(F.col("node").alias("dst"))
    single = e.select("dst").unionAll(outside).groupBy("dst").count().where("count = 1").select("dst")
    one = scratch.save(e.join(single, "dst", "left_semi"), "single")
    symbols = g.nodes.where("label like 'sym:%'").select(F.col("id").alias("dst"))
    seen = new = scratch.save(one.where("kind = 'addr_of'").join(symbols, "dst", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("obj"), F.lit(0).cast("long").alias("off")), "origins")
    step = one.where("kind in ('assign', 'gep')").select(F.col("src").alias("node"), "dst", F.when(F.col("kind") == "assign", 0).when(F.col("modulus").isNull(), F.col("off")).alias("by"))
    while not new.isEmpty():
        new = scratch.save(new.join(step, "node").select(F.col("dst").alias("node"), "obj", F.try_add("off", F.col("by").cast("long")).alias("off")), "new")
        seen = scratch.grow(seen, new, "origins")
    return seen


def init_slots(p: Program, g: Graph, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(obj, off, target) of static initialisers, target null where it is no function, and (obj, reason)
    of globals that an initialiser touches in a way that is not understood."""
    init = g.edges.where(F.col("owner") == INIT)
    stores = init.where("kind = 'store'").select("src", "dst")
    at = stores.join(places.select(F.col("node").alias("dst"), "obj", "off"), "dst", "left")
    value = places.select(F.col("node").alias("src"), F.col("obj").alias("held"))
    at = at.join(value, "src", "left")
    functions = _objects(g, "function").select(F.col("id").alias("held"), F.col("key").alias("target"))
    good = at.where("off is not null and held is not null").join(functions, "held", "left").select("obj", "off", "target")
    bad = [at.where("off is not null and held is null").select("obj", F.lit("store_value_unresolved").alias("reason")), at.where("off is null and obj is not null").select("obj", F.lit("store_address_unresolved"))]
    moved = init.where("kind = 'gep' and (off is null or modulus is not null)").join(places.select(F.col("node").alias("src"), "obj"), "src")
    bad.append(moved.select("obj", F.lit("dynamic_initializer_gep")))
    odd = p.stmts.where("init and kind in ('unknown', 'ptr_to_int', 'int_to_ptr', 'memcpy', 'memset', 'call_direct', 'call_indirect')")
    named = odd.select("module", F.concat(F.lit("unsupported_"), "kind").alias("reason"), F.explode(F.concat(F.array("source", "dst", "src", "operand"), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("operands", "args", "results")])).alias("name"))
    named = named.join(p.symbols.where("object like 'obj:global:%'"), ["module", "name"]).join(g.nodes.select("module", F.col("label").alias("object"), F.col("id").alias("obj")), ["module", "object"])
    bad.append(named.select("obj", "reason"))
    poisoned = bad[0].union(bad[1]).union(bad[2]).union(bad[3])
    return good, poisoned.distinct()


def initval_edges(edges: DataFrame, p: Program, g: Graph, globals_: DataFrame, verdicts: DataFrame, places: DataFrame, options: Options) -> DataFrame:
    """``edges`` with calls of what a stationary global was initialised with in place of coarser answers."""
    slots, _ = init_slots(p, g, places)
    steady = globals_.join(verdicts.where("stationary").select("module", F.col("global").alias("key")), ["module", "key"], "left_semi").select(F.col("id").alias("obj"))
    slots = slots.where("target is not null").join(steady, "obj", "left_semi")
    single = g.edges.where("kind <> 'store' and kind <> 'memcpy'").groupBy("dst").count().where("count = 1").select("dst")
    loads = g.edges.where("kind = 'load'").join(single, "dst", "left_semi").select(F.col("src").alias("node"), "dst").join(places.where("off is not null"), "node")
    sites = g.sites.where("kind = 'call_indirect'").select("module", "caller", "site", F.col("operand").alias("dst"), "cc", "ret", "params")
    f = p.functions.where("address_taken").select("module", F.col("key").alias("target"), F.col("cc").alias("fcc"), F.col("ret").alias("fret"), F.col("params").alias("fparams"))
    hit = sites.join(loads.select("dst", "obj", "off"), "dst").join(slots, ["obj", "off"]).join(f, ["module", "target"]).where((F.col("cc") == F.col("fcc")) & signatures_fit("ret", "params", "fret", "fparams"))
    exact = hit.join(edges.where("tier = 'b2_simple'").select("module", F.col("callsite").alias("site")).distinct(), ["module", "site"], "left_anti").select("module", "caller", "site", "target").distinct()
    left = edges.join(exact.select("module", F.col("site").alias("callsite")).distinct(), ["module", "callsite"], "left_anti").select(edges.columns)
    return left.unionByName(_edge(exact, "caller", "site", "target", "indirect", "b1_initval"))


# ---- accesses


def witness(func: str = "func"):
    """func@file:line:col#0, or the statement's place in the function where it has no location."""
    return F.concat(F.col(func), F.lit("@"), F.when(F.col("at").isNotNull(), F.concat(F.col("at"), F.lit("#0"))).otherwise(F.concat(F.lit("!noloc#"), F.col("idx").cast("string"))))


def modref(p: Program, g: Graph, globals_: DataFrame, solved: omega.Solved | None, options: Options, scratch: Scratch) -> DataFrame:
    """(module, func, global, unknown, access, via, witness, detail, candidates, sample): what each
    function reads and writes, by name and through pointers.

    An access through an address from outside is a row of its own without a global,
    whose candidates are what the address may point at here and what escaped.  An
    address with more than ``fanout`` globals is one such row as well.
    """
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    keys = globals_.select("module", F.col("key").alias("global"))
    direct = p.stmts.where("kind = 'global_ref' and not init").select("module", "func", "global", "access", witness().alias("witness")).join(keys, ["module", "global"], "left_semi")
    direct = direct.select("module", "func", "global", none.alias("unknown"), "access", F.lit("direct").alias("via"), "witness", none.alias("detail"), F.lit(1).cast("long").alias("candidates"), F.col("global").alias("sample"))
    if solved is None:
        return scratch.save(direct.distinct(), "modref")
    e = g.edges.where((F.col("owner") != INIT) & (F.col("idx") >= 0))
    row = lambda kind, access, c, own, detail: e.where(kind).select("module", F.col("owner").alias("func"), F.lit(access).alias("access"), F.col(c).alias("node"), witness("owner").alias("witness"), own.alias("own"), detail.alias("detail"))
    true, false = F.lit(True), F.lit(False)
    detail = F.when(F.col("modeled"), "edge:modeled_external_write").otherwise("edge:store")
    acc = union([
        row("kind = 'load'", "ref", "src", true, F.lit("edge:load")), row("kind = 'store'", "mod", "dst", ~F.col("modeled"), detail),
        row("kind = 'memcpy'", "ref", "src", false, F.lit("edge:memcpy_src")), row("kind = 'memcpy'", "mod", "dst", false, F.lit("edge:memcpy_dst")),
    ]).distinct()
    acc = scratch.save(acc, "accesses")
    names = globals_.select(F.col("id").alias("obj"), F.col("key").alias("global"))
    sets = solved.members.join(names, "obj")
    size = sets.groupBy("set").agg(F.count("*").alias("candidates"), F.array_join(F.slice(F.array_sort(F.collect_set("global")), 1, 8), ",").alias("sample"))
    size = scratch.save(size, "set-sizes")
    small = sets.join(size.where(F.col("candidates") <= options.fanout).select("set"), "set", "left_semi").select("set", "global")
    addressed = acc.join(solved.points, "node", "left")
    # a global's own name is what the direct rows are about
    own = g.edges.where("kind = 'addr_of'").join(g.nodes.where("label like 'sym:global:%'").select(F.col("id").alias("dst")), "dst", "left_semi").join(names.select(F.col("obj").alias("src"), F.col("global").alias("own_global")), "src").select(F.col("dst").alias("node"), "own_global")
    addressed = addressed.join(own, "node", "left")
    aliased = addressed.join(small, "set").where("not own or own_global is null or own_global <> global")
    aliased = aliased.select("module", "func", "global", none.alias("unknown"), "access", F.lit("aliased").alias("via"), "witness", none.alias("detail"), F.lit(1).cast("long").alias("candidates"), F.col("global").alias("sample"))
    aliased = aliased.groupBy("module", "func", "global", "unknown", "access", "via").agg(F.min("witness").alias("witness"), F.first("detail").alias("detail"), F.max("candidates").alias("candidates"), F.max("sample").alias("sample"))
    reason = F.when(F.col("access") == "ref", "omega_load").otherwise("omega_store")
    many = addressed.join(size.where(F.col("candidates") > options.fanout), "set").select("module", "func", none.alias("global"), F.lit("high_fanout").alias("unknown"), "access", F.lit("unknown").alias("via"), "witness", "detail", "candidates", "sample")
    loose = solved.escaped.join(globals_.select(F.col("id").alias("obj"), "module"), "obj").groupBy("module").agg(F.count("*").alias("loose"))
    wild = addressed.join(solved.outside, "node", "left_semi").join(size, "set", "left").join(loose, "module", "left")
    wild = wild.select("module", "func", none.alias("global"), reason.alias("unknown"), "access", F.lit("unknown").alias("via"), "witness", "detail", (F.coalesce("candidates", zero) + F.coalesce("loose", zero)).alias("candidates"), F.coalesce("sample", F.lit("")).alias("sample"))
    return scratch.save(union([direct, aliased, many, wild]).distinct(), "modref")


def global_state(g: Graph, globals_: DataFrame, solved: omega.Solved | None, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, escape, never_written, runtime_written) of each global."""
    named = rows.where("access = 'mod' and global is not null").select("module", F.col("global").alias("key")).distinct().withColumn("row", F.lit(True))
    out = globals_.join(named, ["module", "key"], "left")
    if solved is None:
        return out.select("module", "key", "id", F.when(F.col("exported"), "external").otherwise("module").alias("escape"), F.col("row").isNull().alias("never_written"), F.coalesce("row", F.lit(False)).alias("runtime_written"))
    stores = g.edges.where("kind in ('store', 'memcpy')").select(F.col("dst").alias("node"), (F.col("owner") != INIT).alias("runtime"))
    stored = stores.join(solved.points, "node").groupBy("set").agg(F.max("runtime").alias("runtime")).join(solved.members, "set").groupBy(F.col("obj").alias("id")).agg(F.max("runtime").alias("runtime"))
    out = out.join(stored.withColumn("stored", F.lit(True)), "id", "left").join(solved.escaped.withColumnRenamed("obj", "id").withColumn("loose", F.lit(True)), "id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    never = F.col("is_definition") & ~yes("loose") & ~yes("stored") & ~yes("row")
    return out.select("module", "key", "id", F.when(yes("loose"), "external").otherwise("module").alias("escape"), never.alias("never_written"), (yes("runtime") | yes("row")).alias("runtime_written"))


def stationarity(p: Program, g: Graph, globals_: DataFrame, state: DataFrame, solved: omega.Solved | None, rows: DataFrame, places: DataFrame, options: Options) -> DataFrame:
    """(module, global, complete_initval, stationary, reason, writer): the first reason, in order, why a
    global may change after it is initialised, or that it does not."""
    if solved is None:
        return globals_.select("module", F.col("key").alias("global"), F.lit(False).alias("complete_initval"), F.lit(False).alias("stationary"), F.lit("conservative_stage").alias("reason"), F.lit("").alias("writer"))
    slots, poisoned = init_slots(p, g, places)
    full = slots.select(F.col("obj").alias("id")).distinct().withColumn("has", F.lit(True))
    bad = poisoned.groupBy(F.col("obj").alias("id")).agg(F.min("reason").alias("poison"))
    known = rows.where("access = 'mod' and global is not null").groupBy("module", F.col("global").alias("key")).agg(F.min("witness").alias("writer"))
    # a write through an address from outside may hit what the address points at and what escaped
    e = g.edges.where("kind in ('store', 'memcpy')").where(F.col("owner") != INIT).select("module", "owner", "idx", "at", F.col("dst").alias("node"))
    wild = e.join(solved.outside, "node", "left_semi").select("module", "node", witness("owner").alias("wild"))
    hit = wild.join(solved.points, "node").join(solved.members, "set").groupBy(F.col("obj").alias("id")).agg(F.min("wild").alias("aimed"))
    first = wild.groupBy("module").agg(F.min("wild").alias("any_wild"))
    symbols = g.nodes.where("label like 'sym:global:%'").join(solved.outside.withColumnRenamed("node", "id"), "id", "left_semi").select("module", F.substr("label", F.lit(12)).alias("key")).distinct().withColumn("odd", F.lit(True))
    t = globals_.join(full, "id", "left").join(bad, "id", "left").join(known, ["module", "key"], "left").join(hit, "id", "left").join(first, "module", "left").join(symbols, ["module", "key"], "left")
    t = t.join(state.select("id", "escape"), "id")
    complete = F.coalesce("has", F.lit(False)) & F.col("poison").isNull()
    loose = F.col("exported") | F.coalesce("odd", F.lit(False))
    aimed = F.coalesce("aimed", F.when(F.col("escape") == "external", F.col("any_wild")))
    rules = [
        ("incomplete_initval", ~complete & (F.col("poison").isNotNull() | loose | F.col("writer").isNotNull() | (F.col("has").isNull() & F.lit(False)))),
        ("unknown_runtime_writer", aimed.isNotNull()), ("exported_global", loose), ("runtime_writer", F.col("writer").isNotNull()),
    ]
    reason = D.first_rule(rules, "stationary")
    writer = F.when(reason == "unknown_runtime_writer", aimed).when(reason == "runtime_writer", F.col("writer"))
    return t.select("module", F.col("key").alias("global"), complete.alias("complete_initval"), (reason == "stationary").alias("stationary"), reason.alias("reason"), F.coalesce(writer, F.lit("")).alias("writer"))


def transitive_rows(edges: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of each function and of all that it calls, each fact with its least witness."""
    node = lambda f: F.concat_ws("\x01", "module", f)
    calls = edges.where("caller is not null and callee is not null").select(node("caller").alias("src"), node("callee").alias("dst")).distinct()
    facts = rows.select(node("func").alias("func"), F.concat_ws("\x01", F.coalesce("global", F.lit("")), F.coalesce("unknown", F.lit("")), "access", "via").alias("fact"), "witness")
    found = transitive(calls, facts, scratch)
    part = lambda c, i: F.split(c, "\x01")[i]
    empty = lambda c: F.when(c != "", c)
    return found.select(part("func", 0).alias("module"), part("func", 1).alias("func"), empty(part("fact", 0)).alias("global"), empty(part("fact", 1)).alias("unknown"), part("fact", 2).alias("access"), part("fact", 3).alias("via"), "witness")


# ---- audits, components, reports


def audits(p: Program, g: Graph, solved: omega.Solved | None, scratch: Scratch) -> DataFrame:
    """(module, kind, func, at, affected, witness): what the model of the program does not cover."""
    s = p.stmts.where("not init")
    site = g.sites.select("module", F.col("caller").alias("func"), "idx", "site")
    finding = lambda d, kind, affected, how: d.select("module", kind.alias("kind"), "func", F.coalesce("at", F.lit("")).alias("at"), affected.alias("affected"), how.alias("witness"))
    values = lambda c: F.transform(c, lambda v: F.concat(F.lit("value:"), v))
    asm = s.where("kind = 'unknown' and reason like 'inline_asm%'")
    touched = F.concat(F.coalesce(F.col("operands"), F.array().cast("array<string>")), F.coalesce(F.col("results"), F.array().cast("array<string>")))
    out = [finding(asm, F.lit("inline_asm"), F.array_join(F.when(F.size(touched) > 0, values(touched)).otherwise(F.array(F.concat(F.lit("function:"), "func"))), "|"), witness())]
    calls = s.where("kind in ('call_direct', 'call_indirect')").join(site, ["module", "func", "idx"])
    known = F.create_map(*[F.lit(x) for kv in BOUNDARY_CALLS.items() for x in kv])
    direct = calls.where("kind = 'call_direct'")
    out.append(finding(direct.where(F.col("callee").isin(*BOUNDARY_CALLS)), known[F.col("callee")], F.concat(F.lit("callsite:"), "site"), F.col("site")))
    # functions among variable arguments
    loose = vararg_kinds(p, g)
    extra = calls.join(loose, ["module", "func", "idx"]).select("module", "func", "idx", "at", "site", "audit", F.explode(F.slice("args", F.coalesce(F.size("sig.params"), F.lit(0)) + 1, F.greatest(F.size("args"), F.lit(1)))).alias("v"))
    named = extra.join(p.functions.select("module", F.col("key").alias("v")), ["module", "v"], "left_semi")
    if solved is None:
        text = lambda d, head: d.groupBy("module", "func", "idx", "at", "site", "audit").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit(head), "v"))), "|").alias("affected"))
        out.append(finding(text(named, "function:"), F.col("audit"), F.col("affected"), F.col("site")))
    else:
        reach = reaching_functions(p, g, solved)
        hot = lambda d: operand_nodes(d, p, g).join(reach, "node", "left_semi")
        text = lambda d: d.groupBy("module", "func", "idx", "at", "site", "audit").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("value:"), "v"))), "|").alias("affected"))
        out.append(finding(text(hot(extra)), F.col("audit"), F.col("affected"), F.col("site")))
        casts = s.where("kind = 'ptr_to_int' and not coalesce(comparison_only, false)").select("module", "func", "idx", "at", F.lit("fnptr_ptrtoint").alias("audit"), F.col("source").alias("v"))
        casts = casts.union(s.where("kind = 'int_to_ptr'").select("module", "func", "idx", "at", F.lit("fnptr_inttoptr"), "dest"))
        out.append(finding(hot(casts), F.col("audit"), F.concat(F.lit("value:"), "v"), witness()))
    # copies over aggregates that hold function pointers: allocations of such a type, and what is moved from them
    e = g.edges.where("kind in ('assign', 'gep')").select("src", "dst")
    held = s.where(r"kind = 'alloca' and (ty like '%(%)*%' or ty like '%(...)*%') and (ty like '[%' or ty like '{%' or ty like '\\%%')")
    start = held.select("module", F.concat_ws(":", F.lit("val"), "func", "dest").alias("label")).join(g.nodes.select("module", "label", "id"), ["module", "label"]).select(F.lit(0).alias("origin"), F.col("id").alias("node"))
    flagged = reachable(e, start, scratch).select("node")
    over = s.where("kind = 'memcpy' and not coalesce(proven_fnptr_init, false)").select("module", "func", "idx", "at", F.lit("memcpy_fnptr_aggregate").alias("audit"), F.explode(F.array("dst", "src")).alias("v"))
    over = over.union(s.where("kind = 'memset'").select("module", "func", "idx", "at", F.lit("memset_fnptr_aggregate"), "dst"))
    over = operand_nodes(over, p, g).join(flagged, "node", "left_semi").groupBy("module", "func", "idx", "at", "audit").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("value:"), "v"))), "|").alias("affected"))
    out.append(finding(over, F.col("audit"), F.col("affected"), witness()))
    return union(out).distinct()


def operand_nodes(frame: DataFrame, p: Program, g: Graph) -> DataFrame:
    """``frame`` (module, func, v, ...) with the node of the operand v."""
    named = p.symbols.select("module", F.col("name").alias("v"), "sym")
    label = F.coalesce("sym", F.concat_ws(":", F.lit("val"), "func", "v"))
    return frame.join(named, ["module", "v"], "left").withColumn("label", label).join(g.nodes.select("module", "label", F.col("id").alias("node")), ["module", "label"]).drop("label", "sym")


def reaching_functions(p: Program, g: Graph, solved: omega.Solved) -> DataFrame:
    """(node): values that may point at a function, here or outside."""
    sets = solved.members.join(_objects(g, "function").select(F.col("id").alias("obj")), "obj", "left_semi").select("set").distinct()
    return solved.points.join(sets, "set", "left_semi").select("node").union(solved.outside).distinct()


def vararg_kinds(p: Program, g: Graph) -> DataFrame:
    """(module, func, idx, audit): calls that pass variable arguments which the model does not follow."""
    v = g.sites.where("vararg").select("module", F.col("caller").alias("func"), "idx", "kind", "callee", "fits")
    own = p.functions.select("module", F.col("key").alias("callee"), "external")
    takes = p.stmts.where("kind in ('va_start', 'var_arg', 'va_copy') or kind = 'unknown' and (reason in ('va_arg', 'varargs_intrinsic') or op like 'llvm.va\\_%')").select("module", F.col("func").alias("callee")).distinct().withColumn("takes", F.lit(True))
    modelled = positional(p.functions, p.stmts).select("module", "callee").distinct().withColumn("modelled", F.lit(True))
    v = v.join(own, ["module", "callee"], "left").join(takes, ["module", "callee"], "left").join(modelled, ["module", "callee"], "left")
    kind = F.when(F.col("kind") == "call_indirect", "fnptr_varargs_indirect").when(F.coalesce("fits", F.lit(False)), None).when(F.coalesce("external", F.lit(True)), "fnptr_varargs_external").when(F.coalesce("modelled", F.lit(False)) | F.col("takes").isNull(), None).otherwise("fnptr_varargs_internal_unmodeled")
    return v.select("module", "func", "idx", kind.alias("audit")).where("audit is not null")


def components(p: Program, globals_: DataFrame, state: DataFrame, verdicts: DataFrame, edges: DataFrame, rows: DataFrame, findings: DataFrame, scratch: Scratch) -> DataFrame:
    """(module, id, frozen, taint, members, mutable_globals): functions that calls within a module connect,
    and what keeps them from being rewritten; a component is named after its first member."""
    own = p.functions.select("module", "key", "external")
    inner = own.where("not external").select("module", "key")
    number = scratch.save(own.select("module", "key").withColumn("n", F.monotonically_increasing_id()), "function-numbers")
    pairs = edges.where("caller is not null and callee is not null").join(inner.withColumnRenamed("key", "caller"), ["module", "caller"], "left_semi").join(inner.withColumnRenamed("key", "callee"), ["module", "callee"], "left_semi")
    pairs = pairs.join(number.select("module", F.col("key").alias("caller"), F.col("n").alias("src")), ["module", "caller"]).join(number.select("module", F.col("key").alias("callee"), F.col("n").alias("dst")), ["module", "callee"])
    labels = connected_components(pairs.select("src", "dst").union(number.select("n", "n")), scratch)
    of = number.join(labels.withColumnRenamed("vertex", "n"), "n").select("module", "key", "component")
    of = scratch.save(of.join(of.groupBy("component").agg(F.min("key").alias("id")), "component").select("module", "key", "id"), "component-of")
    taint = [
        rows.where("global is null").select("module", F.col("func").alias("key"), F.lit("unknown_global").alias("kind"), "witness"),
        edges.where("callee is null and caller is not null").select("module", F.col("caller").alias("key"), F.lit("unknown_callee").alias("kind"), F.col("callsite").alias("witness")),
        edges.where("caller is null").select("module", F.col("callee").alias("key"), F.lit("unknown_caller").alias("kind"), F.lit("").alias("witness")),
        findings.select("module", F.col("func").alias("key"), "kind", "witness"),
    ]
    taint = union(taint).join(of, ["module", "key"]).groupBy("module", "id").agg(F.array_sort(F.collect_set(F.struct("kind", F.coalesce("witness", F.lit("")).alias("witness")))).alias("taint"))
    changing = globals_.where("mutable and not is_const").select("module", "key").join(verdicts.where("stationary").select("module", F.col("global").alias("key")), ["module", "key"], "left_anti").select("module", F.col("key").alias("global"))
    touched = rows.where("global is not null").join(changing, ["module", "global"], "left_semi").select("module", F.col("func").alias("key"), "global").join(of, ["module", "key"])
    touched = touched.groupBy("module", "id").agg(F.array_sort(F.collect_set("global")).alias("mutable_globals"))
    out = of.groupBy("module", "id").agg(F.array_sort(F.collect_list("key")).alias("members")).join(taint, ["module", "id"], "left").join(touched, ["module", "id"], "left")
    none = F.array().cast("array<string>")
    return scratch.save(out.select("module", "id", F.col("taint").isNotNull().alias("frozen"), F.coalesce(F.col("taint"), F.array().cast("array<struct<kind:string,witness:string>>")).alias("taint"), "members", F.coalesce(F.col("mutable_globals"), none).alias("mutable_globals")), "components")


def functions_table(p: Program, g: Graph, solved: omega.Solved | None) -> DataFrame:
    f = p.functions.select("module", "key", "file", "line", "external", "exported", "address_taken", "vararg", F.concat("cc", F.lit(" "), "ret", F.lit("("), "params", F.lit(")")).alias("sig"))
    if solved is None:
        return f.withColumn("address_escaped", F.col("address_taken") & ~F.col("external"))
    known = solved.escaped.join(_objects(g, "function").withColumnRenamed("id", "obj"), "obj").select("module", "key").withColumn("known", F.lit(True))
    exported = F.col("exported") | F.col("external")
    return f.join(known, ["module", "key"], "left").withColumn("address_escaped", F.coalesce("known", F.lit(False)) & ~exported).drop("known")


def globals_table(globals_: DataFrame, state: DataFrame, verdicts: DataFrame) -> DataFrame:
    v = verdicts.select("module", F.col("global").alias("key"), F.col("stationary").alias("initval_stable"))
    rows = globals_.join(state.select("id", "escape", "never_written", "runtime_written"), "id").join(v, ["module", "key"])
    return rows.select("module", "key", "is_const", (F.col("mutable") & ~F.col("is_const")).alias("mutable"), "exported", "is_definition", "escape", "never_written", "runtime_written", "initval_stable", "size_bits")


def metrics(p: Program, g: Graph, globals_: DataFrame, edges: DataFrame, rows: DataFrame, parts: DataFrame, state: DataFrame) -> DataFrame:
    """One row per module: counts, and how many mutable globals no frozen component touches."""
    count = lambda d, name: d.groupBy("module").agg(F.count("*").alias(name))
    mutable = globals_.where("mutable and not is_const")
    each = parts.select("module", "frozen", F.explode("mutable_globals").alias("global"))
    clean = each.where("not frozen").select("module", "global").distinct().join(each.where("frozen").select("module", "global").distinct(), ["module", "global"], "left_anti")
    out = p.functions.select("module").union(p.globals.select("module")).distinct()
    tables = {"functions": p.functions, "globals": globals_, "callsites": g.sites, "call_edges": edges, "modref_rows": rows, "mutable_globals_total": mutable, "in_rewritable_components": clean, "components": parts, "icalls_unknown": edges.where("kind = 'indirect' and callee is null"), "pag_edges": g.edges, "pag_nodes": g.nodes}
    for name, table in tables.items():
        out = out.join(count(table, name), "module", "left")
    return out.na.fill(0)


def differential(spark: SparkSession, source: str | DataFrame, options: Options = Options(), stages: tuple[str, ...] = ("conservative", "steens", "andersen")) -> DataFrame:
    """``ledger`` of runs of the stages, without exact answers in place of theirs."""
    return ledger({s: analyze(spark, source, replace(options, stage=s, exact=False)) for s in stages})


def ledger(runs: dict[str, Analysis]) -> DataFrame:
    """(module, fact, coarse, fine, facts, violations): a finer run's call edges, callers outside and
    escaped globals must be among those of the run before it, where unknown contains all."""
    rows, stages = [], list(runs)
    for coarse, fine in zip(stages, stages[1:], strict=False):
        a, b = runs[coarse].callgraph, runs[fine].callgraph
        own = b.where("kind = 'indirect' and callee is not null").select("module", "callsite", "callee")
        missed = own.join(a.select("module", "callsite", "callee"), ["module", "callsite", "callee"], "left_anti").join(a.where("callee is null").select("module", "callsite").distinct(), ["module", "callsite"], "left_anti")
        rows.append(("icall_targets", coarse, fine, own, missed))
        own = b.where("callee is null and kind = 'indirect'").select("module", "callsite").distinct()
        rows.append(("icall_unknown", coarse, fine, own, own.join(a.where("callee is null").select("module", "callsite"), ["module", "callsite"], "left_anti")))
        own = b.where("caller is null").select("module", "callee")
        rows.append(("unknown_callers", coarse, fine, own, own.join(a.where("caller is null").select("module", "callee"), ["module", "callee"], "left_anti")))
        if coarse != "conservative":
            own = runs[fine].globals.where("escape = 'external'").select("module", "key")
            rows.append(("escaped_globals", coarse, fine, own, own.join(runs[coarse].globals.where("escape = 'external'"), ["module", "key"], "left_anti").select("module", "key")))
    count = lambda fact, a, b, d, n: d.groupBy("module").agg(F.count("*").alias(n)).select("module", F.lit(fact).alias("fact"), F.lit(a).alias("coarse"), F.lit(b).alias("fine"), n)
    out = [count(f, a, b, own, "facts").join(count(f, a, b, missed, "violations"), ["module", "fact", "coarse", "fine"], "left").na.fill(0) for f, a, b, own, missed in rows]
    return union(out)
