"""What variadic functions get is only read: fixtures, one function or chain a case."""

from fathomline.operators import tails
from fathomline.runtime import Scratch

STMT = "func string, kind string, dest string, op1 string, op2 string, pointer boolean"


def proofs(spark, stmts, args=(), params=(), starts=(), reads=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = tails.tail_proofs(
        frame(stmts, STMT), frame(args, "func string, callee string, pos long, value string"), frame(params, "func string, pos long, value string"),
        frame(starts, "func string, value string"), frame(reads, "callee string, pos long"), Scratch(spark, "t"),
    )
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_uses_of_lists_and_of_what_is_read_from_them(spark):
    load = lambda f, dest, at, pointer=True: (f, "load", dest, at, None, pointer)
    stmts = [
        load("plain", "x", "ap"), load("plain", "y", "x"), ("plain", "gep", "z", "y", None, True),
        load("ret", "x", "ap"), ("ret", "return", None, "x", None, True),
        load("number", "x", "ap", False), ("number", "return", None, "x", None, True),
        load("through", "x", "ap"), ("through", "store", None, "q", "x", True),
        load("kept", "x", "ap"), ("kept", "store", None, "x", "q", True),
        ("listkept", "assign", "b", "ap", None, True), ("listkept", "store", None, "b", "q", True),
        load("mixed", "x", "ap"), ("mixed", "assign", "x", "ap", None, True),
        ("cast", "gep", "b", "ap", None, True), ("cast", "ptr_to_int", "n", "b", None, False),
        ("icall", "call_indirect", "r", "q", "ap", True),
        ("other", "return", None, "q", None, True), ("closed", "return", None, None, None, True),
    ]
    names = ["plain", "ret", "number", "through", "kept", "listkept", "mixed", "cast", "icall", "other"]
    got = proofs(spark, stmts, starts=[(f, "ap") for f in names] + [("closed", None), ("twice", "ap"), ("twice", "ap")])
    assert got == {"plain": True, "ret": False, "number": True, "through": False, "kept": False, "listkept": False, "mixed": False, "cast": False, "icall": False, "other": True, "closed": False, "twice": True}


def test_lists_and_tails_given_to_callees(spark):
    stmts = [
        ("reader", "load", "x", "l", None, True), ("writer", "load", "x", "l", None, True), ("writer", "store", None, "q", "x", True),
        ("taker", "store", None, "q", "t", True), ("tail_in", "load", "x", "ap", None, True), ("to_len", "load", "x", "ap", None, True), ("to_odd", "load", "x", "ap", None, True),
        ("ping", "load", "x", "l", None, True), ("pong_bad", "return", None, "l", None, True),
    ]
    args = [
        ("a", "reader", 0, "ap"), ("b", "mid", 0, "ap"), ("mid", "writer", 0, "l"), ("tail_in", "taker", 0, "x"),
        ("to_len", "len", 0, "x"), ("to_odd", "len", 1, "x"), ("list_out", "len", 0, "ap"), ("beyond", "reader", 1, "ap"), ("opens", "opens_too", 0, "ap"),
        ("rec", "ping", 0, "ap"), ("ping", "pong", 0, "l"), ("pong", "ping", 0, "l"),
        ("rec_bad", "ping2", 0, "ap"), ("ping2", "pong2", 0, "l"), ("pong2", "ping2", 0, "l"), ("pong2", "pong_bad", 0, "l"), ("rec", None, 0, "ap"), ("rec", "writer", 0, None),
    ]
    params = [(f, 0, "l") for f in ("reader", "writer", "mid", "ping", "pong", "ping2", "pong2", "pong_bad", "opens_too")] + [("taker", 0, "t")]
    starts = [(f, "ap") for f in ("a", "b", "tail_in", "to_len", "to_odd", "list_out", "beyond", "opens", "opens_too", "rec", "rec_bad")]
    got = proofs(spark, stmts, args, params, starts, reads=[("len", 0)])
    assert got == {"a": True, "b": False, "tail_in": False, "to_len": True, "to_odd": False, "list_out": False, "beyond": False, "opens": False, "opens_too": True, "rec": True, "rec_bad": False}


def test_no_rows(spark):
    assert proofs(spark, []) == {}
