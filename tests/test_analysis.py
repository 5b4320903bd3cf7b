"""Small programs of our own, all analysed in one run per stage, with the answers that each stage must give."""

import json

import pytest

from fathomline import analysis
from fathomline.analysis import Options

V, I = {"class": "void"}, {"class": "integer"}


def sig(ret=V, *params, vararg=False):
    return {"ret": ret, "params": list(params), "vararg": vararg, "cc": "ccc"}


def func(key, body=(), s=None, **more):
    return {"key": key, "sig": s or sig(), "body": list(body), **more}


def at(line):
    return {"file": "a.c", "line": line, "col": 1}


def icall(operand="%fp", s=None, args=(), **more):
    return {"kind": "call_indirect", "operand": operand, "sig": s or sig(), "args": list(args), **more}


def call(callee, s=None, args=(), **more):
    return {"kind": "call_direct", "callee": callee, "sig": s or sig(), "args": list(args), **more}


def store(address, value, **more):
    return {"kind": "store", "address": address, "value": value, **more}


def load(dest, address, **more):
    return {"kind": "load", "dest": dest, "address": address, **more}


def assign(dest, *sources):
    return {"kind": "assign", "dest": dest, "sources": list(sources)}


def gep(dest, base, off):
    return {"kind": "gep", "dest": dest, "base": base, "byte_off": off}


def taken(*keys, **more):
    return [func(k, address_taken=True, **more) for k in keys]


def glob(key, **more):
    return {"key": key, "mutable": True, **more}


TARGET = {"triple": "x", "data_layout": "e-m:e-i64:64", "supported_atomic_widths": []}
LONG = dict(integer_bits=64, pointer_bits=64, pointer_address_space=0)

MODULES = {
    # a table of handlers that other modules see, filled at one place and fired at another
    "hooks": dict(
        functions=[func("install", [gep("%h", "@Hooks", 8), store("%h", "on_open")]), func("fire", [gep("%k", "@Hooks", 8), load("%f", "%k"), icall("%f")]), *taken("on_open", "idle")],
        globals=[glob("@Hooks", exported=True), glob("@Count")],
    ),
    # a callback handed on by arguments, results and copies
    "pass": dict(
        functions=[
            func("main", [call("give", sig(I), dest="%r"), call("run", sig(V, I), ["%r"])], exported=True),
            func("give", [{"kind": "return", "value": "@one"}], sig(I)),
            func("run", [icall("%p")], sig(V, I), param_names=["%p"]),
            *taken("one", "two"),
        ]
    ),
    # fields of one object are told apart, unless the offset is unknown
    "fields": dict(
        functions=[
            func("main", [
                {"kind": "alloca", "dest": "%s", "ty": "{ void ()*, void ()* }"}, gep("%a", "%s", 0), gep("%b", "%s", 8), store("%a", "one"), store("%b", "two"), load("%fa", "%a"), icall("%fa", loc=at(1)),
                {"kind": "alloca", "dest": "%t", "ty": "{ void ()* }"}, gep("%c", "%t", 0), gep("%d", "%t", None), store("%c", "one"), store("%d", "two"), load("%fc", "%c"), icall("%fc", loc=at(2)),
            ]),
            *taken("one", "two"),
        ]
    ),
    # a buffer that code outside fills, with an address in it
    "filled": dict(
        functions=[func("probe", [{"kind": "alloca", "dest": "%buf", "ty": "i8*"}, store("%buf", "@Shared"), call("fill", sig(V, I), ["%buf"]), load("%q", "%buf", loc=at(3)), icall("%q", loc=at(5))]), func("fill", (), sig(V, I), external=True)],
        globals=[glob("@Shared"), glob("@Private")],
    ),
    # a handler given to code outside: what it stores through its argument and what it returns get out
    "notified": dict(
        functions=[
            func("main", [call("subscribe", sig(V, I), ["@notify"])]), func("subscribe", (), sig(V, I), external=True),
            func("notify", [store("%slot", "@Box"), load("%leaf", "@Inner"), {"kind": "return", "value": "%leaf"}], sig(I, I), param_names=["%slot"], address_taken=True),
        ],
        globals=[glob("@Box"), glob("@Inner"), glob("@Leaf"), glob("@Calm")],
        global_init=[store("@Inner", "@Leaf")],
    ),
    # structures copied whole, by a copy of memory and by value
    "structs": dict(
        functions=[
            func("main", [
                {"kind": "alloca", "dest": "%s", "ty": "{ void ()*, void ()* }"}, gep("%a", "%s", 0), gep("%b", "%s", 8), store("%a", "one"), store("%b", "two"),
                {"kind": "alloca", "dest": "%t", "ty": "{ void ()*, void ()* }"}, {"kind": "memcpy", "dst": "%t", "src": "%s", "bytes": 16}, gep("%c", "%t", 8), load("%f", "%c"), icall("%f", loc=at(1)),
                call("byv", sig(V, {"class": "byval", "size": 16}), ["%s"]),
            ]),
            func("byv", [gep("%m", "%p", 8), load("%y", "%m"), icall("%y", loc=at(2))], sig(V, {"class": "byval", "size": 16}), param_names=["%p"]),
            *taken("one", "two"),
        ]
    ),
    # reads and writes by name, through one pointer, through an unknown one
    "access": dict(
        functions=[func("main", [{"kind": "global_ref", "global": "@D", "access": "ref", "loc": at(1)}, assign("%g", "@A"), load("%v", "%g", loc=at(3)), store("%g", "%x", loc=at(4)), {"kind": "int_to_ptr", "dest": "%u", "source": "%bits"}, load("%r", "%u", loc=at(6)), store("%u", "%y", loc=at(7))])],
        globals=[glob("@D"), glob("@A")],
    ),
    # copies of memory, filling it, and library functions with a contract
    "memory": dict(
        functions=[
            func("main", [
                assign("%d", "@To"), assign("%s", "@From"), {"kind": "memcpy", "dst": "%d", "src": "%s", "bytes": 8, "loc": at(1)}, {"kind": "memset", "dst": "%d", "value": "0", "bytes": 8, "loc": at(2)},
                call("strncpy", sig(I, I, I, I), ["%d", "%s", "8"], dest="%back", loc=at(3)), store("%back", "%z", loc=at(4)), load("%f", "@To"), icall("%f", loc=at(5)),
                call("printf", sig(I, I, vararg=True), ["@.str", "%d"], dest="%n", loc=at(6)),
            ]),
            func("init", [store("@From", "one")]), func("strncpy", (), sig(I, I, I, I), external=True), func("printf", (), sig(I, I, vararg=True), external=True), *taken("one", "two"),
        ],
        globals=[glob("@To"), glob("@From"), {"key": "@.str", "mutable": False, "is_const": True, "initializer_ir": 'c"%s ok\\00"'}],
    ),
    # integers: a lossless round trip, a literal, a use besides the cast back
    "casts": dict(
        target=TARGET,
        functions=[
            func("main", [
                {"kind": "ptr_to_int", "dest": "%i", "source": "@one", **LONG}, {"kind": "int_to_ptr", "dest": "%p", "source": "%i", **LONG}, icall("%p", loc=at(1)),
                {"kind": "int_to_ptr", "dest": "%q", "source": "i64 12", **LONG}, icall("%q", loc=at(2)),
                {"kind": "ptr_to_int", "dest": "%j", "source": "@G", **LONG}, {"kind": "int_to_ptr", "dest": "%k", "source": "%j", **LONG}, {"kind": "scalar_op", "dest": "%l", "op": "add", "lhs": "8", "rhs": "%j"},
            ]),
            *taken("one", "two"),
        ],
        globals=[glob("@G"), glob("@H")],
    ),
    # static initialisers: a table that stays, one that is written, one that is not understood
    "tables": dict(
        functions=[
            func("main", [gep("%s", "@T", 8), load("%f", "%s"), icall("%f", loc=at(1)), load("%h", "@W"), icall("%h", loc=at(2)), store("@W", "two", loc=at(3)), {"kind": "global_ref", "global": "@W", "access": "mod", "loc": at(3)}]),
            *taken("one", "two", "three"),
        ],
        globals=[glob("@T"), glob("@W"), glob("@P"), glob("@N")],
        global_init=[store("@T", "one"), gep("@i1", "@T", 8), store("@i1", "two"), store("@W", "one"), gep("@i2", "@P", None), store("@i2", "three")],
    ),
    # arguments that a function takes by position, and by-value aggregates
    "args": dict(
        functions=[
            func("main", [call("va", sig(V, I, vararg=True), ["0", "@one", "@two"]), {"kind": "alloca", "dest": "%agg", "ty": "{ void ()* }"}, store("%agg", "two"), call("byv", sig(V, {"class": "byval", "size": 8}), ["%agg"])]),
            func("va", [{"kind": "va_start", "list": "%l"}, {"kind": "var_arg", "dest": "%x", "position": {"kind": "exact", "index": 0}}, icall("%x", loc=at(1)), {"kind": "va_end", "list": "%l"}], sig(V, I, vararg=True), param_names=["%n"]),
            func("byv", [load("%y", "%b"), icall("%y", loc=at(2)), store("%b", "one")], sig(V, {"class": "byval", "size": 8}), param_names=["%b"]),
            *taken("one", "two"),
        ]
    ),
    # what the model does not cover, each freezing its own component
    "audit": dict(
        functions=[
            func("asm", [{"kind": "unknown", "op": "call", "reason": "inline_asm", "operands": [], "results": ["%r"], "loc": at(1)}]), func("dl", [call("dlsym", sig(I, I), ["0"], dest="%h", loc=at(2))]), func("calm", [{"kind": "global_ref", "global": "@C", "access": "mod", "loc": at(3)}]),
            func("tell", [call("log", sig(V, I, vararg=True), ["0", "@one"], loc=at(4))]), func("log", (), sig(V, I, vararg=True), external=True), func("dlsym", (), sig(I, I), external=True), *taken("one"),
            func("agg", [{"kind": "alloca", "dest": "%t", "ty": "[2 x void ()*]"}, assign("%u", "%t"), {"kind": "memset", "dst": "%u", "value": "0", "bytes": 16, "loc": at(5)}]),
        ],
        globals=[glob("@C")],
    ),
    "empty": dict(functions=[]),
}


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pir")
    for name, m in MODULES.items():
        (folder / f"{name}.pir.json").write_text(json.dumps({"module": name, **m}, indent=1))
    return {s: analysis.analyze(spark, str(folder), Options(stage=s, build_mode="library")) for s in ("conservative", "steens", "andersen")} | {"folder": str(folder)}


def targets(a, module, line=None):
    rows = [r for r in a.callgraph.collect() if r.module == module and r.kind == "indirect" and (line is None or f":{line}:" in (r.callsite or ""))]
    return {r.callee or "?" for r in rows}


def rows(a, table, module, *columns):
    return {tuple(r[c] for c in columns) for r in a.tables[table].collect() if r.module == module}


def test_call_targets_by_stage(runs):
    want = {
        ("hooks", None): ({"on_open", "idle", "?"}, {"on_open", "?"}, {"on_open", "?"}),
        ("structs", 1): ({"one", "two", "?"}, {"one", "two"}, {"two"}),
        ("structs", 2): ({"one", "two", "?"}, {"one", "two"}, {"two"}),
        ("pass", None): ({"one", "two", "?"}, {"one"}, {"one"}),
        ("fields", 1): ({"one", "two", "?"}, {"one", "two"}, {"one"}),
        ("fields", 2): ({"one", "two", "?"}, {"one", "two"}, {"one", "two"}),
        ("filled", 5): ({"?"}, {"?"}, {"?"}),
        ("memory", 5): ({"one", "two", "?"}, {"one"}, {"one"}),
        ("casts", 1): ({"one", "two", "?"}, {"one"}, {"one"}),
        ("casts", 2): ({"one", "two", "?"}, {"?"}, {"?"}),
        ("args", 1): ({"one", "two", "?"}, {"one"}, {"one"}),
        ("tables", 1): ({"one", "two", "three", "?"}, {"two"}, {"two"}),
        ("tables", 2): ({"one", "two", "three", "?"}, {"one", "two"}, {"one", "two"}),
    }
    got = {k: tuple(targets(runs[s], *k) for s in ("conservative", "steens", "andersen")) for k in want}
    assert got == want
    assert targets(runs["andersen"], "args", 2) == {"one", "two"}
    assert "two" not in {r.callee for r in runs["andersen"].callgraph.collect() if r.module == "pass"}


def test_tiers_and_direct_calls(runs):
    tier = lambda s, m: rows(runs[s], "callgraph", m, "kind", "tier")
    assert ("indirect", "b2_simple") in tier("andersen", "pass") and ("indirect", "b1_initval") in tier("steens", "tables")
    assert ("indirect", "andersen") in tier("andersen", "fields") and ("indirect", "steens") in tier("steens", "fields")
    direct = {(r.caller, r.callsite, r.callee) for r in runs["steens"].callgraph.collect() if r.module == "pass" and r.kind == "direct" and r.caller}
    assert direct == {("main", "main@!noloc#0", "give"), ("main", "main@!noloc#1", "run")}


def test_callers_outside(runs):
    outer = lambda s, m: {r.callee for r in runs[s].callgraph.collect() if r.module == m and r.caller is None}
    assert outer("conservative", "hooks") == {"on_open", "idle"}
    for s in ("steens", "andersen"):
        assert outer(s, "hooks") == {"on_open"} and outer(s, "filled") == {"fill"} and outer(s, "notified") == {"notify", "subscribe"} and outer(s, "pass") == {"main"}
        assert rows(runs[s], "functions", "hooks", "key", "address_escaped") == {("install", False), ("fire", False), ("on_open", True), ("idle", False)}


def test_what_escapes(runs):
    for s in ("steens", "andersen"):
        escape = lambda m: dict(rows(runs[s], "globals", m, "key", "escape"))  # noqa: E731, B023
        assert escape("hooks") == {"@Hooks": "external", "@Count": "module"}
        assert escape("filled") == {"@Shared": "external", "@Private": "module"}
        assert escape("notified") == {"@Box": "external", "@Inner": "module", "@Leaf": "external", "@Calm": "module"}
        assert escape("casts")["@G"] == "external" and escape("casts")["@H"] == "module"
        assert escape("memory") == {"@To": "module", "@From": "module"}
        never = lambda m: dict(rows(runs[s], "globals", m, "key", "never_written"))  # noqa: E731, B023
        assert never("hooks") == {"@Hooks": False, "@Count": True} and never("filled") == {"@Shared": False, "@Private": True}


def test_reads_and_writes(runs):
    plain = rows(runs["conservative"], "modref", "access", "func", "global", "access", "via", "witness")
    assert plain == {("main", "@D", "ref", "direct", "main@a.c:1:1#0")}
    for s in ("steens", "andersen"):
        got = rows(runs[s], "modref", "access", "func", "global", "unknown", "access", "via", "witness")
        assert got == {
            ("main", "@D", None, "ref", "direct", "main@a.c:1:1#0"), ("main", "@A", None, "ref", "aliased", "main@a.c:3:1#0"), ("main", "@A", None, "mod", "aliased", "main@a.c:4:1#0"),
            ("main", None, "omega_load", "ref", "unknown", "main@a.c:6:1#0"), ("main", None, "omega_store", "mod", "unknown", "main@a.c:7:1#0"),
        }
        memory = rows(runs[s], "modref", "memory", "global", "access")
        assert {("@To", "mod"), ("@To", "ref"), ("@From", "ref")} <= memory
        lines = {r.at for r in runs[s].graph.edges.collect() if r.module == "memory" and r.kind in ("store", "memcpy")}
        assert {"a.c:1:1", "a.c:2:1", "a.c:3:1", "a.c:4:1"} <= lines
    assert ("main", "@W", "mod", "direct") in rows(runs["andersen"], "transitive", "tables", "func", "global", "access", "via")


def test_printf_with_a_constant_format_only_reads(runs):
    modeled = [r for r in runs["andersen"].graph.edges.collect() if r.module == "memory" and r.at == "a.c:6:1"]
    assert {r.kind for r in modeled} == {"load"} and len(modeled) == 2


def test_stationarity(runs):
    for s in ("steens", "andersen"):
        reason = dict(rows(runs[s], "stationarity", "tables", "global", "reason"))
        assert reason == {"@T": "stationary", "@W": "runtime_writer", "@P": "incomplete_initval", "@N": "stationary"}
    assert {r.reason for r in runs["conservative"].stationarity.collect()} == {"conservative_stage"}


def test_components_and_audits(runs):
    found = rows(runs["steens"], "audit", "audit", "kind", "func")
    assert {("inline_asm", "asm"), ("dlopen_dlsym", "dl"), ("fnptr_varargs_external", "tell"), ("memset_fnptr_aggregate", "agg")} <= found
    parts = {r.id: r for r in runs["steens"].components.collect() if r.module == "audit"}
    assert parts["asm"].frozen and parts["dl"].frozen and parts["tell"].frozen and parts["agg"].frozen and not parts["calm"].frozen
    assert parts["calm"].mutable_globals == ["@C"] and "inline_asm" in {t.kind for t in parts["asm"].taint}
    by = {r.module: r for r in runs["steens"].metrics.collect()}
    assert by["audit"].in_rewritable_components == 1 and by["hooks"].functions == 4 and by["hooks"].mutable_globals_total == 2
    conservative = {r.id: r.frozen for r in runs["conservative"].components.collect() if r.module == "pass"}
    assert conservative["give"] and {t.kind for r in runs["conservative"].components.collect() if r.module == "pass" for t in r.taint} == {"unknown_callee", "unknown_caller"}


def test_finer_stages_only_narrow(runs):
    ledger = analysis.ledger({s: runs[s] for s in ("conservative", "steens", "andersen")}).collect()
    assert ledger and not [r for r in ledger if r.violations]
    assert {r.fact for r in ledger} == {"icall_targets", "icall_unknown", "unknown_callers", "escaped_globals"}


def test_exports(spark, runs, tmp_path):
    runs["andersen"].export(str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out" / "callgraph.jsonl").glob("part-*")) for x in f.read_text().splitlines()]
    assert len(lines) == runs["andersen"].callgraph.count()
    assert lines == sorted(lines, key=lambda r: tuple((r[c] is not None, r[c] or "") for c in analysis.ORDER["callgraph"]))


def test_options_and_bad_input(spark, tmp_path):
    m = {"module": "m", "functions": [func("main", [{"kind": "int_to_ptr", "dest": "%t", "source": "%x"}, store("@G", "%t"), call("api")], sig(I, I, I), param_names=["%c", "%v"]), func("api", exported=True), *taken("cb")], "globals": [glob("@G", exported=True)]}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(m))
    a = analysis.analyze(spark, str(path), Options(build_mode="executable", exports=("cb",), assume_tags=True))
    assert {r.callee for r in a.callgraph.collect() if r.caller is None} == {"main", "cb"}
    assert {r.key: r.escape for r in a.globals.collect()} == {"@G": "module"}
    marks = {(r.mark, r.source) for r in a.graph.marks.collect()}
    assert not any(s.startswith("int_to_ptr") for _, s in marks) and ("outside", "entry") in marks
    m["functions"].append(func("api"))
    path.write_text(json.dumps(m))
    with pytest.raises(ValueError, match="twice"):
        analysis.analyze(spark, str(path))
