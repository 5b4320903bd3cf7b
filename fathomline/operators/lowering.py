"""From programs to the pointer assignment graph: every statement kind, over many modules at once.

Each statement becomes rows of one shape, its ends given as operands ("o" and the
spelling) or as nodes ("n" and the label).  Operands are resolved by one join with the
module's symbols; labels become dense numbers at the end.  Where code outside may read,
write or call, a mark says so, and the solvers decide what follows from it:

    outside  the value may be an address that the module knows nothing of
    leaks    code outside gets the value
    escaped  code outside knows the object
    payload  what the value points at holds such addresses

Labels: obj:global:K, obj:function:K, obj:alloca:F:d, obj:heap:F:i, obj:byval:F:i:p,
obj:external:name, sym:global:K, sym:function:K, param:F:i, ret:F, val:F:v.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Scratch
from ..sources import pir as P
from .slices import without_percent_n

#: Numbers of objects begin here, so that none is a value's, nor a cell of an object.
OBJECTS = 1 << 36
#: Integers that no object lies at, as the first and the last of the address space.
RESERVED = 4096
INIT = "global_init"


@dataclass(frozen=True)
class Options:
    """What changes answers: the solver, what other modules see, and the contract for integers."""

    stage: str = "andersen"  # or steens, conservative
    build_mode: str = "executable"  # or library
    exports: tuple[str, ...] = ()
    assume_tags: bool = False
    fields: bool = True
    fanout: int = 16
    exact: bool = True
    context_depth: int = 8


@dataclass
class Program:
    functions: DataFrame
    globals: DataFrame
    stmts: DataFrame
    kinds: DataFrame
    spaces: DataFrame
    symbols: DataFrame


@dataclass
class Graph:
    nodes: DataFrame  # module, label, id, carries, empty
    edges: DataFrame  # module, owner, idx, kind, src, dst, off, modulus, residue, width, wide, modeled, loc
    sites: DataFrame  # module, caller, idx, site, kind, callee, operand, args, result, sig fields, boundary, loc
    marks: DataFrame  # module, mark, node, source


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def bare(c: Column) -> Column:
    return F.regexp_replace(c, "^@", "")


def class_text(c: Column) -> Column:
    """An ABI class as text, with its size if it has one, closed by a comma."""
    return F.concat(F.coalesce(c["class"], F.lit("void")), F.coalesce(c["size"].cast("string"), F.lit("")), F.lit(","))


def signature(sig: str) -> list[Column]:
    """Columns cc, ret, params and vararg of a signature; params is text that begins with its shorter fits."""
    s = F.col(sig)
    params = F.coalesce(F.array_join(F.transform(s["params"], class_text), ""), F.lit(""))
    return [F.coalesce(s["cc"], F.lit("ccc")).alias("cc"), class_text(s["ret"]).alias("ret"), params.alias("params"), F.coalesce(s["vararg"], F.lit(False)).alias("vararg"), F.coalesce(F.size(s["params"]), F.lit(0)).alias("nparams")]


def loc_text() -> Column:
    loc = F.col("loc")
    return F.when(loc.isNotNull(), F.concat_ws(":", loc["file"], loc["line"].cast("string"), loc["col"].cast("string")))


def program(modules: DataFrame, options: Options, scratch: Scratch) -> Program:
    """The tables of all modules, with what files may leave out filled in."""
    listed = F.lit(False) if not options.exports else F.col("key").isin(*options.exports)
    shown = F.col("exported") if options.build_mode == "library" else F.lit(False)
    entry = F.lit(False) if options.build_mode == "library" else F.col("key") == "main"
    f = P.functions(modules).withColumn("exported", listed | shown | entry)
    g = P.globals_(modules).withColumn("exported", listed | shown)
    f = scratch.save(f.select("module", "func", "key", *signature("sig"), "sig", "param_names", "external", "exported", "address_taken", "file", "line"), "functions")
    g = scratch.save(g, "globals")
    s = P.statements(modules).withColumn("init", F.col("func") == "").withColumn("func", F.when(F.col("init"), INIT).otherwise(F.col("func")))
    s = scratch.save(s.withColumn("at", loc_text()), "stmts")
    kinds = scratch.save(P.value_kinds(modules), "kinds")
    return Program(f, g, s, kinds, scratch.save(P.odd_spaces(modules), "spaces"), scratch.save(symbols(f, g), "symbols"))


def symbols(functions: DataFrame, globals_: DataFrame) -> DataFrame:
    """(module, name, object, sym): what an operand names: a key as it stands, or behind an @."""
    rows = []
    for table, sort, turn in ((globals_, "global", 0), (functions, "function", 1)):
        for shift, name in ((0, F.col("key")), (2, F.concat(F.lit("@"), F.col("key")))):
            rows.append(table.select("module", name.alias("name"), F.struct(F.lit(shift + turn).alias("turn"), F.concat(F.lit(f"obj:{sort}:"), "key").alias("object"), F.concat(F.lit(f"sym:{sort}:"), "key").alias("sym")).alias("s")))
    return union(rows).groupBy("module", "name").agg(F.min("s").alias("s")).select("module", "name", "s.object", "s.sym")


# ---- rows of one shape


def op(c) -> Column:
    return F.concat(F.lit("o"), F.col(c) if isinstance(c, str) else c)


def val(c) -> Column:
    return F.concat(F.lit("nval:"), F.col("func"), F.lit(":"), F.col(c) if isinstance(c, str) else c)


def node(*parts) -> Column:
    return F.concat(F.lit("n"), F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def sink(name: str) -> Column:
    """A value of the statement that holds no address."""
    return val(F.concat(F.lit(f"@{name}:"), F.col("idx").cast("string")))


def edge(kind: str, src: Column, dst: Column, off=None, lane=None, width=None, wide=None, modeled: bool = False) -> Column:
    nothing = F.lit(None).cast("long")
    return F.struct(
        F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), (nothing if off is None else off).cast("long").alias("off"),
        (nothing if lane is None else lane["modulus"]).cast("long").alias("modulus"), (nothing if lane is None else lane["residue"]).cast("long").alias("residue"),
        (nothing if width is None else width).cast("long").alias("width"), (F.lit(False) if wide is None else wide).alias("wide"), F.lit(modeled).alias("modeled"),
    )


def _rows(frame: DataFrame, *edges: Column) -> DataFrame:
    return frame.select("module", "func", "idx", "at", F.explode(F.array(*edges)).alias("e")).select("module", "func", "idx", "at", "e.*")


def local_edges(s: DataFrame) -> DataFrame:
    """Edges of the statements that need no other table."""
    true = F.lit(True)
    each = {
        "alloca": [edge("addr_of", node("obj:alloca", F.col("func"), F.col("dest")), val("dest"))],
        "load": [edge("load", op("address"), val("dest"), width=F.col("access_bytes"))],
        "store": [edge("store", op("value"), op("address"), width=F.col("access_bytes"))],
        "gep": [edge("gep", op("base"), val("dest"), F.col("byte_off"), F.col("lane"))],
        "memcpy": [edge("memcpy", op("src"), op("dst"), width=F.col("bytes"))],
        "memset": [edge("store", sink("fill"), op("dst"), width=F.col("bytes"), wide=F.col("bytes").isNull())],
        "va_start": [edge("store", sink("list"), op("list"), wide=true, modeled=True)],
        "va_end": [edge("store", sink("list"), op("list"), wide=true, modeled=True), edge("load", op("list"), sink("list"), wide=true)],
        "va_copy": [edge("load", op("src"), sink("list"), wide=true), edge("store", sink("list"), op("dst"), wide=true, modeled=True)],
    }
    rows = [_rows(s.where(F.col("kind") == kind), *edges) for kind, edges in each.items()]
    rows.append(_rows(s.where("kind = 'assign'").withColumn("from", F.explode("sources")), edge("assign", op("from"), val("dest"))))
    rows.append(_rows(s.where("kind = 'return' and value is not null and not init"), edge("assign", op("value"), node("ret", F.col("func")))))
    return union(rows)


def inputs(s: DataFrame) -> DataFrame:
    """(module, func, idx, kind, operand): every value that a statement reads."""
    one = ("lhs", "rhs", "address", "value", "base", "source", "list", "dst", "src", "operand")
    many = ("sources", "operands", "args")
    all_ = F.concat(F.array(*one), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in many])
    return s.select("module", "func", "idx", "kind", F.explode(all_).alias("operand")).where("operand is not null")


def round_trips(s: DataFrame, spaces: DataFrame) -> DataFrame:
    """(module, func, cast_idx, back_idx, pointer): casts to an integer of the pointer's width, of which
    every use, wherever it stands in a statement, is a later cast back."""
    plain = F.col("targeted") & (F.col("integer_bits") == F.col("pointer_bits")) & ~F.array_contains("odd", F.col("pointer_address_space"))
    there = s.where("kind = 'ptr_to_int'").join(spaces, "module").where(plain)
    there = there.select("module", "func", F.col("idx").alias("cast_idx"), F.col("dest").alias("integer"), F.col("source").alias("pointer"), "integer_bits", "pointer_address_space")
    uses = inputs(s).withColumnRenamed("operand", "integer")
    used = there.join(uses, ["module", "func", "integer"])
    back = s.where("kind = 'int_to_ptr'").select("module", "func", "idx", F.col("integer_bits").alias("bits"), F.col("pointer_bits").alias("back"), F.col("pointer_address_space").alias("space"))
    used = used.join(back, ["module", "func", "idx"], "left")
    fits = (F.col("kind") == "int_to_ptr") & (F.col("idx") > F.col("cast_idx")) & (F.col("bits") == F.col("integer_bits")) & (F.col("back") == F.col("integer_bits")) & (F.col("space") == F.col("pointer_address_space"))
    used = used.withColumn("fits", F.coalesce(fits, F.lit(False)))
    good = used.groupBy("module", "func", "cast_idx").agg(F.bool_and("fits").alias("all")).where("all").select("module", "func", "cast_idx")
    defined = s.where("dest is not null").groupBy("module", "func", F.col("dest").alias("integer")).count().where("count = 1").select("module", "func", "integer")
    return used.join(good, ["module", "func", "cast_idx"], "left_semi").join(defined, ["module", "func", "integer"], "left_semi").select("module", "func", "cast_idx", F.col("idx").alias("back_idx"), "pointer")


def reserved(spaces_joined: DataFrame) -> Column:
    """Whether an int_to_ptr's source is a literal that no object lies at."""
    token = F.element_at(F.split(F.trim("source"), r"\s+"), -1)
    digits = F.regexp_replace(token, r"^[+-]", "")
    number = F.when(digits.rlike("^0[xX][0-9a-fA-F]{1,16}$"), F.conv(F.substring(digits, 3, 16), 16, 10).cast("decimal(38,0)")).when(digits.rlike("^[0-9]{1,38}$"), digits.cast("decimal(38,0)"))
    ones = F.when(F.col("integer_bits") <= 120, F.pow(F.lit(2.0), F.col("integer_bits")).cast("decimal(38,0)") - 1)
    low = number < RESERVED
    high = ~token.startswith("-") & (number <= ones) & (ones - number < RESERVED - 1)
    whole = F.col("targeted") & (F.col("integer_bits") == F.col("pointer_bits")) & (F.col("integer_bits") > 0) & (F.col("pointer_address_space") == 0) & ~F.array_contains("odd", F.lit(0))
    return F.coalesce(whole & (low | high), F.lit(False))


def far_uses(s: DataFrame) -> DataFrame:
    """(module, func, value): values whose address matters: read or written through, moved or called."""
    each = [s.select("module", "func", F.col(c).alias("value"), "kind").where(k) for c, k in (("address", "kind in ('load', 'store')"), ("base", "kind = 'gep'"), ("operand", "kind = 'call_indirect'"), ("dst", "kind in ('memcpy', 'memset')"), ("src", "kind = 'memcpy'"))]
    return union(each).select("module", "func", "value").distinct()


def positional(functions: DataFrame, s: DataFrame) -> DataFrame:
    """(module, callee, dest, how, at): values that a function takes from its variable arguments by
    position, where every caller is known and passes them."""
    f = functions.where("vararg and not external and not address_taken and not exported").select("module", F.col("key").alias("callee"), F.col("nparams").alias("fixed"))
    takes = s.where("kind = 'var_arg'").select("module", F.col("func").alias("callee"), "dest", F.col("position.kind").alias("how"), F.coalesce("position.index", F.lit(0)).alias("at"))
    odd = s.where("kind = 'unknown' and (reason in ('va_arg', 'varargs_intrinsic') or op like 'llvm.va\\_%')").select("module", F.col("func").alias("callee")).distinct()
    least = s.where("kind = 'call_direct'").groupBy("module", "callee").agg(F.min(F.coalesce(F.size("args"), F.lit(0))).alias("passed"))
    most = takes.groupBy("module", "callee").agg(F.max("at").alias("last"))
    good = f.join(most, ["module", "callee"]).join(least, ["module", "callee"]).where("passed > fixed + last").join(odd, ["module", "callee"], "left_anti")
    return takes.join(good.select("module", "callee", "fixed"), ["module", "callee"]).withColumn("at", F.col("at") + F.col("fixed")).drop("fixed")


def direct_calls(p: Program, contracts: DataFrame) -> DataFrame:
    """Direct calls with their callee's declaration and the contract that fits it by name and shape."""
    calls = p.stmts.where("kind = 'call_direct'").select("module", "func", "idx", "at", "callee", "dest", F.coalesce("args", F.array().cast("array<string>")).alias("args"), "sig", *signature("sig"))
    own = p.functions.select("module", F.col("key").alias("callee"), "external", F.col("cc").alias("fcc"), F.col("ret").alias("fret"), F.col("params").alias("fparams"), F.col("vararg").alias("fvararg"), F.col("nparams").alias("fnparams"), F.col("sig").alias("fsig"))
    known = F.broadcast(contracts.select("name", "fixed_params", F.col("vararg").alias("cvararg"), "result", "reads", "writes", "copies", "policy"))  # of fixed size
    calls = calls.join(own, ["module", "callee"], "left").withColumn("declared", F.col("external").isNotNull()).withColumn("external", F.coalesce("external", F.lit(True)))
    calls = calls.withColumn("name", F.when(bare(F.col("callee")).startswith("__ctype_get_"), "__ctype_get_").otherwise(bare(F.col("callee")))).join(known, "name", "left")
    n = F.size("args")
    same = (F.col("cc") == F.col("fcc")) & (F.col("ret") == F.col("fret")) & (F.col("params") == F.col("fparams")) & (F.col("vararg") == F.col("fvararg"))
    shape = (F.col("cc") == "ccc") & (F.col("vararg") == F.col("cvararg")) & (F.col("nparams") == F.col("fixed_params")) & F.forall(F.coalesce(F.col("sig.params"), F.array().cast(f"array<{P.CLASS}>")), lambda x: x["class"] == "integer")
    count = F.when(F.col("cvararg") & (F.col("policy") != "no_variadic"), n >= F.col("fixed_params")).otherwise(n == F.col("fixed_params"))
    gives = F.when(F.col("result") == "void", (F.col("ret") == "void,") & F.col("dest").isNull()).otherwise(F.col("ret") == "integer,")
    return calls.withColumn("fits", F.coalesce(F.col("declared") & F.col("external") & same & shape & count & gives, F.lit(False)))


def contract_edges(calls: DataFrame, p: Program) -> tuple[DataFrame, DataFrame]:
    """What calls with a contract do to memory, and marks (module, mark, ref, source) for pointers they read in."""
    c = calls.where("fits")
    has = F.col("dest").isNotNull()
    arg = lambda i: op(F.get("args", F.lit(i) if isinstance(i, int) else i))
    alias = F.regexp_extract("result", "^alias([0-9])", 1).try_cast("int")
    rows = [
        _rows(c.where(has & alias.isNotNull()).withColumn("alias", alias), edge("assign", op(F.get("args", F.col("alias"))), val("dest"))),
        _rows(c.where(has & F.col("result").rlike("fresh$")), edge("addr_of", node("obj:heap", F.col("func"), F.col("idx")), val("dest"))),
        _rows(c.where(has & (F.col("result") == "external")), edge("addr_of", node("obj:external", F.col("name")), val("dest"))),
        _rows(c.where(has & (F.col("result") == "ctype")), edge("addr_of", node("obj:external", "ctype-slot"), val("dest")), edge("addr_of", node("obj:external", "ctype-table"), node("obj:external", "ctype-slot"))),
        _rows(c.where("policy = 'stores0to1'"), edge("store", arg(0), arg(1), wide=F.lit(True), modeled=True)),
    ]
    state = node("val:state", F.col("name"))
    kept = c.where("policy = 'retains0'")
    rows.append(_rows(kept, edge("addr_of", node("obj:external:state", F.col("name")), state), edge("store", arg(0), state, wide=F.lit(True), modeled=True)))
    rows.append(_rows(kept.where(has), edge("load", state, val("dest"), wide=F.lit(True))))
    copy = c.where("copies is not null").withColumn("to", F.split("copies", "<")[0].cast("int")).withColumn("from", F.split("copies", "<")[1].cast("int"))
    size = F.element_at(F.split(F.trim(F.get("args", F.lit(2))), r"\s+"), -1)
    copy = copy.withColumn("size", F.when(size.rlike("^[0-9]{1,18}$"), size.cast("long"))).where("size is null or size <> 0")
    rows.append(_rows(copy, edge("memcpy", op(F.get("args", F.col("from"))), op(F.get("args", F.col("to"))), width=F.col("size"))))
    # a format that is a constant without %n only reads
    texts = p.symbols.join(p.globals.where("is_const or not mutable").select("module", F.concat(F.lit("obj:global:"), "key").alias("object"), "initializer_ir"), ["module", "object"])
    texts = texts.select("module", F.col("name").alias("format"), "initializer_ir")
    c = c.withColumn("format", F.when(F.col("policy") == "printf", F.get("args", F.col("fixed_params") - 1))).join(texts, ["module", "format"], "left")
    safe = F.coalesce(F.col("initializer_ir").rlike('^.*c".*\\\\00"$') & without_percent_n(F.col("initializer_ir")), F.lit(False))
    more = lambda cond: F.when(cond & (F.size("args") > F.col("fixed_params")), F.sequence(F.col("fixed_params"), F.size("args") - 1)).otherwise(F.array().cast("array<int>"))
    printf, scanf = F.col("policy") == "printf", F.col("policy") == "scanf"
    c = c.withColumn("reads", F.concat("reads", more(printf))).withColumn("writes", F.concat("writes", more(scanf), more(printf & ~safe)))
    rows.append(_rows(c.withColumn("i", F.explode("reads")), edge("load", op(F.get("args", F.col("i"))), sink("effect"), wide=F.lit(True))))
    into = F.when(scanf & (F.col("i") >= F.col("fixed_params")), sink("read-in")).otherwise(sink("effect"))
    rows.append(_rows(c.withColumn("i", F.explode("writes")).where("i < size(args)"), edge("store", into, op(F.get("args", F.col("i"))), wide=F.lit(True), modeled=True)))
    marks = c.where(scanf).select("module", "func", F.lit("outside").alias("mark"), sink("read-in").alias("ref"), F.concat(F.lit("read-in:"), "name").alias("source"))
    return union(rows), marks


def binding_edges(calls: DataFrame, p: Program, taken: DataFrame) -> DataFrame:
    """Arguments to parameters, by position, and results back, of direct calls within a module."""
    own = calls.where("not external")
    args = own.select("module", "func", "idx", "at", "callee", "fnparams", "fsig", F.posexplode("args").alias("pos", "arg"))
    args = args.withColumn("class", F.when(F.col("pos") < F.col("fnparams"), F.get("fsig.params", F.col("pos"))["class"])).withColumn("size", F.get("fsig.params", F.col("pos"))["size"])
    param = node("param", F.col("callee"), F.col("pos"))
    rows = [
        _rows(args.where("pos < fnparams and class <> 'byval'"), edge("assign", op("arg"), param)),
        _rows(args.where("class = 'byval'"), edge("addr_of", node("obj:byval", F.col("func"), F.col("idx"), F.col("pos")), param), edge("memcpy", op("arg"), param, width=F.col("size"))),
        _rows(own.where("dest is not null"), edge("assign", node("ret", F.col("callee")), val("dest"))),
    ]
    more = args.join(taken.withColumnRenamed("dest", "into"), ["module", "callee"]).where("how = 'exact' and pos = at_ or how = 'from' and pos >= at_")
    rows.append(_rows(more, edge("assign", op("arg"), node("val", F.col("callee"), F.col("into")))))
    named = p.functions.select("module", F.col("key").alias("func"), F.lit(-1).alias("idx"), F.lit(None).cast("string").alias("at"), "nparams", F.posexplode("param_names").alias("pos", "name")).where("pos < nparams")
    rows.append(_rows(named, edge("assign", node("param", F.col("func"), F.col("pos")), val("name"))))
    return union(rows)


def _numbered(labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(module, label, id): numbers without gaps in the order of modules and labels, objects from OBJECTS on."""
    keys = labels.withColumn("object", F.col("label").startswith("obj:")).repartitionByRange(16, "object", "module", "label").withColumn("part", F.spark_partition_id())
    keys = scratch.save(keys, "labels")
    counts = keys.groupBy("object", "part").agg(F.count("*").alias("c"))
    before = counts.select("object", "part", F.coalesce(F.sum("c").over(W.partitionBy("object").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("object", "part").orderBy("module", "label")) - 1 + F.col("before")
    return keys.join(before, ["object", "part"]).select("module", "label", (rank + F.when(F.col("object"), OBJECTS).otherwise(0)).alias("id"))


def build(p: Program, contracts: DataFrame, options: Options, scratch: Scratch) -> Graph:
    """The graph of all modules."""
    s = p.stmts
    calls = scratch.save(direct_calls(p, contracts), "direct")
    taken = positional(p.functions, s).withColumnRenamed("at", "at_")
    trips = scratch.save(round_trips(s, p.spaces), "trips")
    effects, read_in = contract_edges(calls, p)
    lossless = s.where("kind = 'int_to_ptr'").join(trips.select("module", "func", F.col("back_idx").alias("idx"), "pointer"), ["module", "func", "idx"])
    raw = union([local_edges(s), effects, binding_edges(calls, p, taken), _rows(lossless, edge("assign", op("pointer"), val("dest")))])
    raw = scratch.save(raw, "raw")

    # boundaries of casts, unknown statements and variable arguments
    mark = lambda frame, name, ref, source: frame.select("module", "func", F.lit(name).alias("mark"), ref.alias("ref"), source.alias("source"))
    where = lambda k: F.concat_ws(":", F.lit(k), F.col("func"), F.coalesce("at", F.col("idx").cast("string")))
    cast = s.where("kind = 'ptr_to_int' and not coalesce(comparison_only, false)").join(trips.select("module", "func", F.col("cast_idx").alias("idx")).distinct(), ["module", "func", "idx"], "left_anti")
    back = s.where("kind = 'int_to_ptr'").join(trips.select("module", "func", F.col("back_idx").alias("idx")).distinct(), ["module", "func", "idx"], "left_anti").join(p.spaces, "module")
    back = back.withColumn("reserved", reserved(back))
    if options.assume_tags:
        near = back.join(far_uses(s).select("module", "func", F.col("value").alias("dest"), F.lit(True).alias("far")), ["module", "func", "dest"], "left")
        back = near.withColumn("reserved", F.col("reserved") | F.col("far").isNull()).drop("far")
    back = scratch.save(back.select("module", "func", "idx", "at", "dest", "reserved"), "back")
    unknown = s.where("kind = 'unknown'")
    uses = unknown.withColumn("v", F.explode("operands"))
    makes = unknown.withColumn("v", F.explode("results"))
    asm = F.coalesce(F.col("reason").startswith("inline_asm"), F.lit(False))
    lists = s.where("kind in ('va_start', 'va_copy')").join(taken.select("module", F.col("callee").alias("func")).distinct(), ["module", "func"], "left_anti")
    marks = [
        read_in, mark(cast, "leaks", op("source"), where("ptr_to_int")), mark(back.where("not reserved"), "outside", val("dest"), where("int_to_ptr")),
        mark(uses.where(~asm), "leaks", op("v"), where("unknown")), mark(makes.where(~asm), "outside", val("v"), where("unknown")),
        mark(uses.where(asm), "leaks", op("v"), where("inline_asm")), mark(makes.where(asm), "outside", val("v"), where("inline_asm")),
        mark(lists, "payload", op(F.coalesce("list", "dst")), where("va_list")),
    ]

    # call sites, numbered in each function over both kinds
    every = s.where("kind in ('call_direct', 'call_indirect')").select("module", "func", "idx", "at", "kind", "callee", "operand", F.coalesce("args", F.array().cast("array<string>")).alias("args"), "dest", *signature("sig"))
    ordinal = (F.row_number().over(W.partitionBy("module", "func").orderBy("idx")) - 1).cast("string")
    every = every.withColumn("site", F.concat(F.col("func"), F.lit("@"), F.coalesce("at", F.lit("!noloc")), F.lit("#"), ordinal))
    every = every.join(calls.select("module", "func", "idx", "external", "fits"), ["module", "func", "idx"], "left")
    every = scratch.save(every.withColumn("boundary", F.coalesce(F.col("external") & ~F.col("fits"), F.lit(False))), "call-sites")
    outer = every.where("boundary")
    passed = outer.withColumn("v", F.explode("args"))
    marks += [mark(passed, "leaks", op("v"), F.concat(F.lit("external-call:"), "site")), mark(outer.where("dest is not null"), "outside", val("dest"), F.concat(F.lit("external-call:"), "site"))]
    consumers = s.where("kind in ('va_start', 'var_arg', 'va_copy') or kind = 'unknown' and (reason in ('va_arg', 'varargs_intrinsic') or op like 'llvm.va\\_%')").select("module", F.col("func").alias("callee")).distinct()
    loose = every.where("vararg and kind = 'call_direct' and not external").join(consumers, ["module", "callee"], "left_semi").join(taken.select("module", "callee").distinct(), ["module", "callee"], "left_anti")
    loose = loose.unionByName(every.where("vararg and kind = 'call_indirect'"))
    extra = loose.withColumn("v", F.explode(F.when(F.size("args") > F.col("nparams"), F.slice("args", F.col("nparams") + 1, F.size("args"))).otherwise(F.array().cast("array<string>"))))
    marks.append(mark(extra, "leaks", op("v"), F.concat(F.lit("vararg-call:"), "site")))

    # what other modules see
    sign = lambda frame, name, label, source: frame.select("module", F.lit(INIT).alias("func"), F.lit(name).alias("mark"), F.concat(F.lit("n"), label).alias("ref"), source.alias("source"))
    g_obj, f_obj = F.concat(F.lit("obj:global:"), F.col("key")), F.concat(F.lit("obj:function:"), F.col("key"))
    marks += [
        sign(p.globals.where("exported"), "escaped", g_obj, F.concat(F.lit("exported-symbol:"), g_obj)), sign(p.functions.where("exported"), "escaped", f_obj, F.concat(F.lit("exported-symbol:"), f_obj)),
        sign(p.functions.where("external"), "escaped", f_obj, F.concat(F.lit("imported-symbol:"), f_obj)),
    ]
    if options.build_mode == "executable":
        main = p.functions.where("key = 'main' and nparams > 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("nparams") - 1)))
        marks.append(sign(main, "outside", F.concat(F.lit("param:main:"), F.col("i").cast("string")), F.lit("entry")))
    marks = union(marks)

    # references to labels
    names = p.symbols.select("module", "name", "sym")
    def resolved(frame: DataFrame, *refs: str) -> DataFrame:
        for r in refs:
            sym = names.select(F.col("module").alias("_m"), F.concat(F.lit("o"), "name").alias("_r"), F.col("sym").alias("_s"))
            frame = frame.join(sym, (F.col("module") == F.col("_m")) & (F.col(r) == F.col("_r")), "left")
            label = F.when(F.col(r).startswith("n"), F.substr(F.col(r), F.lit(2))).otherwise(F.coalesce("_s", F.concat(F.lit("val:"), F.col("func"), F.lit(":"), F.substr(F.col(r), F.lit(2)))))
            frame = frame.withColumn(r, label).drop("_m", "_r", "_s")
        return frame

    edges = scratch.save(resolved(raw, "src", "dst"), "label-edges")
    marks = scratch.save(resolved(marks, "ref").where("ref is not null").select("module", "mark", F.col("ref").alias("label"), "source").distinct(), "label-marks")
    sites = every.withColumn("operand_ref", op("operand")).withColumn("result", F.when(F.col("dest").isNotNull(), F.concat(F.lit("val:"), "func", F.lit(":"), "dest")))
    sites = resolved(sites, "operand_ref")
    args = resolved(every.where("kind = 'call_indirect'").select("module", "func", "site", F.posexplode("args").alias("pos", "arg")).withColumn("arg", op("arg")), "arg")
    used = union([edges.select("module", F.col("src").alias("sym")), edges.select("module", F.col("dst").alias("sym")), marks.select("module", F.col("label").alias("sym")), sites.select("module", F.col("operand_ref").alias("sym")), args.select("module", F.col("arg").alias("sym"))]).where("sym like 'sym:%'").distinct()
    addresses = used.join(p.symbols.select("module", "sym", "object").distinct(), ["module", "sym"])
    fixed = addresses.select("module", F.lit(INIT).alias("func"), F.lit(-1).alias("idx"), F.lit(None).cast("string").alias("at"), edge("addr_of", F.col("object"), F.col("sym")).alias("e")).select("module", "func", "idx", "at", "e.*")
    edges = scratch.save(edges.unionByName(fixed), "all-edges")
    ends = [edges.select("module", F.col(c).alias("label")) for c in ("src", "dst")] + [marks.select("module", "label"), sites.select("module", F.col("operand_ref").alias("label")), sites.select("module", F.col("result").alias("label")), args.select("module", F.col("arg").alias("label"))]
    ends += [p.globals.select("module", g_obj.alias("label")), p.functions.select("module", f_obj.alias("label")), p.functions.select("module", F.concat(F.lit("ret:"), "key").alias("label"))]
    ends.append(p.functions.where("nparams > 0").select("module", F.explode(F.transform(F.sequence(F.lit(0), F.col("nparams") - 1), lambda i: F.concat_ws(":", F.lit("param"), "key", i.cast("string")))).alias("label")))
    ends.append(sites.select("module", F.concat(F.lit("site:"), "site").alias("label")))
    omega = p.functions.select("module").union(p.globals.select("module")).distinct()
    ends.append(omega.select("module", F.explode(F.array(F.lit("obj:outside"), F.lit("val:outside"), F.lit("val:leaked"))).alias("label")))
    nodes = _numbered(union(ends).where("label is not null").distinct(), scratch)
    value = F.when(F.col("label").startswith("val:"), F.regexp_extract("label", r"^val:[^:]*:(?s)(.*)$", 1))
    params = p.functions.select("module", "key", F.posexplode("param_names").alias("pos", "name")).select("module", F.concat_ws(":", F.lit("param"), "key", F.col("pos").cast("string")).alias("label"), "name")
    nodes = nodes.join(params, ["module", "label"], "left").withColumn("value", F.coalesce("name", value)).join(p.kinds, ["module", "value"], "left")
    empty = (F.col("value") == "null") & (F.col("vkind") == "pointer") & F.col("label").startswith("val:")
    tagged = back.where("reserved").select("module", F.concat(F.lit("val:"), "func", F.lit(":"), "dest").alias("label"), F.lit(True).alias("tag")).distinct()
    scalar = F.col("label").rlike("^val:[^:]*:@(fill|list|effect):[0-9]+$") | (F.coalesce(F.col("vkind"), F.lit("")) == "non_pointer")
    nodes = nodes.join(tagged, ["module", "label"], "left").select("module", "label", "id", (~scalar).alias("carries"), (F.coalesce(empty, F.lit(False)) | F.coalesce("tag", F.lit(False))).alias("empty"))
    nodes = scratch.save(nodes, "nodes")
    ids = nodes.select("module", "label", "id")
    at = lambda frame, c, out: frame.join(ids.select("module", F.col("label").alias(c), F.col("id").alias(out)), ["module", c], "left").drop(c)
    e = at(at(edges, "src", "from"), "dst", "to").select("module", F.col("func").alias("owner"), "idx", "kind", F.col("from").alias("src"), F.col("to").alias("dst"), "off", "modulus", "residue", "width", "wide", "modeled", "at")
    sites = at(at(sites, "operand_ref", "operand_id"), "result", "result_id")
    args = at(args, "arg", "id").groupBy("module", "site").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("args_id"))
    sites = sites.join(args, ["module", "site"], "left").select("module", F.col("func").alias("caller"), "idx", "at", "site", "kind", "callee", F.col("operand").alias("operand_text"), "args", F.col("operand_id").alias("operand"), F.col("result_id").alias("result"), F.col("args_id.id").alias("args_id"), "cc", "ret", "params", "vararg", "nparams", "boundary", "fits", "external")
    marks = at(marks, "label", "node").select("module", "mark", "node", "source")
    return Graph(nodes, scratch.save(e, "edges"), scratch.save(sites, "sites"), scratch.save(marks, "marks"))
