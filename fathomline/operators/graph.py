"""Graph fixpoints over edge tables: closure, strong components, dominators, reachability.

Every loop materialises its rounds (see ``runtime``) and works on integer ids.  The
number of rounds follows the logarithm of path lengths where paths are doubled, and
path lengths where a frontier moves; a round is one or two shuffles on the join key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


#: Rows of a round's news up to which they are broadcast, so that the whole they meet stays where it lies.
FEW = 1 << 20


#: The same for rows with texts, which take several times the memory.
FEW_TEXTS = FEW // 8


def near(rows: DataFrame, count: int, few: int = FEW) -> DataFrame:
    """``rows``, broadcast if few, else merged with what they meet, however small its files are."""
    return F.broadcast(rows) if count <= few else rows.hint("merge")


def unseen(found: DataFrame, seen: DataFrame, scratch: Scratch, label: str, few: int = FEW) -> tuple[DataFrame, int]:
    """Distinct rows of ``found`` that ``seen`` lacks, and their number.  A few are looked up in ``seen``
    where it lies, as an anti-join would shuffle all of it; they are rows without nulls."""
    keys = found.columns
    found = scratch.save(found.distinct(), f"{label}-found")
    size = found.count()
    if 0 < size <= few:
        known = seen.select(*keys).join(F.broadcast(found), keys, "left_semi")
        new = found.join(F.broadcast(known), keys, "left_anti")
    else:
        new = found.join(seen.hint("merge"), keys, "left_anti") if size else found
    new = scratch.save(new, label)
    return new, new.count()


#: Times that a graph is trimmed; long chains would need as many as they are long.
TRIMS = 4


def transitive_closure(edges: DataFrame, scratch: Scratch, most: int | None = None) -> DataFrame | None:
    """All (src, dst) with a path of one edge or more, by squaring.

    Null ends are dropped; repeated edges and loops count once.  With ``most``, None as
    soon as there are more pairs.
    """
    every = scratch.save(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    size = every.count()
    while True:
        right = every.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
        squared = every.join(right, "dst").select("src", F.col("to").alias("dst"))
        wider = scratch.save(every.union(squared).distinct(), "closure")
        scratch.drop(every)
        every, now = wider, wider.count()
        if now == size:
            return every
        if most is not None and now > most:
            return None
        size = now


def reachable(edges: DataFrame, start: DataFrame, scratch: Scratch, key: str = "node") -> DataFrame:
    """(origin, node): nodes reached from each origin's start nodes, themselves included.

    ``start`` has (origin, node).  A semi-naive frontier: each round follows only what
    the last one added.
    """
    steps = scratch.save(edges.select(F.col("src").alias("node"), "dst").distinct(), "steps")
    seen = scratch.save(start.select("origin", "node").where("node is not null").distinct(), "seen")
    new, count = seen, seen.count()
    few = FEW_TEXTS if "string" in dict(seen.dtypes).values() else FEW
    while count:
        found = near(new, count, few).join(steps, "node").select("origin", F.col("dst").alias("node"))
        new, count = unseen(found, seen, scratch, "new", few)
        seen = scratch.grow(seen, new, "seen")
    return seen


#: Edges (16 bytes each) up to which one task finds the strong components.
SMALL = 1 << 20


def _tarjan(batches):
    """(node, component) of the edges of one task: depth-first, with a stack of its own."""
    src, dst = (np.concatenate(x) for x in zip(*[(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches] or [(np.zeros(0, np.int64),) * 2], strict=True))
    names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n, m = len(names), len(src)
    order = np.argsort(at[:m], kind="stable")
    to, first = at[m:][order].tolist(), np.searchsorted(at[:m][order], np.arange(n + 1)).tolist()
    seen, low, open_, least, path, turn = [0] * n, [0] * n, [False] * n, [0] * n, [], 0
    for root in range(n):
        if seen[root]:
            continue
        work = [(root, first[root])]
        while work:
            v, i = work.pop()
            if not seen[v]:
                turn += 1
                seen[v] = low[v] = turn
                open_[v] = True
                path.append(v)
            elif i > first[v]:  # back from the child before i
                low[v] = min(low[v], low[to[i - 1]]) if open_[to[i - 1]] else low[v]
            while i < first[v + 1]:
                w = to[i]
                i += 1
                if not seen[w]:
                    work += [(v, i), (w, first[w])]
                    break
                if open_[w]:
                    low[v] = min(low[v], seen[w])
            else:
                if low[v] == seen[v]:
                    cut = path.index(v) if path[-1] != v else len(path) - 1
                    name = min(path[cut:])
                    for w in path[cut:]:
                        open_[w], least[w] = False, name
                    del path[cut:]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[np.array(least, np.int64)])], names=["node", "component"])


def _spread(edges: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the least label among a node and all that reach it; a label is a node's number, so
    each round also takes the label that the label's own node has."""
    while True:
        along = labels.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node"), "label")
        jump = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("to")), "label").select("node", F.col("to").alias("label"))
        wider = labels.union(along).union(jump).groupBy("node").agg(F.min("label").alias("label"))
        wider = scratch.save(wider, "labels")
        if wider.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty():
            return wider
        labels = wider


def strong_components(edges: DataFrame, scratch: Scratch, small: int = SMALL) -> DataFrame:
    """(node, component, size): component is the least node on common cycles, itself if on none.

    Up to ``small`` edges are walked in one task.  Beyond, nodes that cannot lie on a
    cycle are trimmed from both sides a few times; then each node learns the least node
    that reaches it and the least that it reaches.  Where these are one, it names the
    component; edges between nodes that differ in either lie in none and are cut, and
    what is left is done again.  No step holds pairs of nodes.
    """
    plain = scratch.save(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null").distinct(), "edges")
    nodes = plain.select(F.col("src").alias("node")).union(plain.select("dst")).distinct()
    if plain.count() <= small:
        named = scratch.save(plain.coalesce(1).mapInArrow(_tarjan, "node long, component long"), "strong")
    else:
        core, found = plain.where("src <> dst"), []
        while True:
            for _ in range(TRIMS):
                sources, targets = core.select(F.col("src").alias("n")), core.select(F.col("dst").alias("n"))
                core = scratch.save(core.join(targets.distinct(), core.src == F.col("n"), "left_semi").join(sources.distinct(), core.dst == F.col("n"), "left_semi"), "core")
            if core.isEmpty():
                break
            start = core.select(F.col("src").alias("node")).union(core.select("dst")).distinct()
            start = scratch.save(start.select("node", F.col("node").alias("label")), "start")
            ahead = _spread(core, start, scratch)
            back = _spread(core.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, scratch)
            both = scratch.save(ahead.join(back.withColumnRenamed("label", "behind"), "node"), "both")
            found.append(both.where("label = behind").select("node", F.col("label").alias("component")))
            left = both.where("label <> behind")
            end = lambda c: left.select(F.col("node").alias(c), F.col("label").alias(f"{c}_a"), F.col("behind").alias(f"{c}_b"))  # noqa: E731, B023
            core = scratch.save(core.join(end("src"), "src").join(end("dst"), "dst").where("src_a = dst_a and src_b = dst_b").select("src", "dst"), "core")
        cycle = found[0] if found else start_nothing(nodes)
        for more in found[1:]:
            cycle = cycle.union(more)
        named = scratch.save(nodes.join(cycle, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "strong")
    return named.join(named.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size")


def start_nothing(nodes: DataFrame) -> DataFrame:
    return nodes.limit(0).select("node", F.col("node").alias("component"))


#: Steps, and steps with writes, of a function up to which its flow graph is one row, worked on where it lies.
MOST_STEPS = 1024
#: Stands for a null global, which no join would find again.
NO_GLOBAL = -(1 << 63)


def _by_size(steps: DataFrame, scratch: Scratch, most: int, *more: DataFrame, odd: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``steps`` of functions with up to ``most`` rows in it and ``more`` and none in ``odd``, and of the
    others, None if there are none."""
    size = steps.select("func")
    for other in more:
        size = size.union(other.select("func"))
    big = size.groupBy("func").agg(F.count("*").alias("n")).where(F.col("n") > most).select("func")
    big = scratch.save(big if odd is None else big.union(odd.select("func")).distinct(), "big")
    if big.isEmpty():
        return steps, None
    return steps.join(big, "func", "left_anti"), steps.join(big, "func", "left_semi")


def _as_row(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(func, a, b): each function's pairs as two arrays; pairs with nulls count for nothing."""
    pair = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).cast("long").alias(a), F.col(b).cast("long").alias(b)))
    return pairs.where("func is not null").groupBy("func").agg(F.collect_list(pair).alias("p")).select("func", F.col(f"p.{a}").alias(a), F.col(f"p.{b}").alias(b))


class _Rows:
    """``work`` on each function's arrays, which gives two lists of longs, as batches (func, names)."""

    def __init__(self, work, *names: str):
        self.work, self.names = work, names

    def __call__(self, batches):
        for batch in batches:
            arrays = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False).tolist()) for c in batch.columns[1:]]
            at, a, b = [], [], []
            for k in range(batch.num_rows):
                left, right = self.work(*[values[offs[k] : offs[k + 1]] for offs, values in arrays])
                at += [k] * len(left)
                a += left
                b += right
                if len(at) > 100_000 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["func", *self.names])
                    at, a, b = [], [], []


def _members(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def _finished(ahead: dict[int, list[int]], roots) -> list[int]:
    """Nodes that ``roots`` reach, each after those that a depth-first walk goes on to from it."""
    seen, out = set(), []
    for root in roots:
        if root in seen:
            continue
        seen.add(root)
        work = [(root, iter(ahead.get(root, ())))]
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in seen:
                    seen.add(to)
                    work.append((to, iter(ahead.get(to, ()))))
                    break
            else:
                out.append(node)
                work.pop()
    return out


class _Dominators:
    def __init__(self, entry: int):
        self.entry = entry

    def __call__(self, src, dst):
        """Sets of dominators as bits, in reverse postorder, until none shrinks."""
        ahead, back = {}, {}
        for a, b in zip(src, dst, strict=True):
            ahead.setdefault(a, []).append(b)
            back.setdefault(b, []).append(a)
        order = _finished(ahead, [self.entry])[::-1]
        number = {v: i for i, v in enumerate(order)}
        before = [[number[x] for x in back.get(v, ()) if x in number] for v in order]
        every = (1 << len(order)) - 1
        dom = [1] + [every] * (len(order) - 1)
        shrunk = True
        while shrunk:
            shrunk = False
            for i in range(1, len(order)):
                both = every
                for j in before[i]:
                    both &= dom[j]
                both |= 1 << i
                if both != dom[i]:
                    dom[i], shrunk = both, True
        node, over = [], []
        for i, v in enumerate(order):
            ends = [order[j] for j in _members(dom[i])]
            node += [v] * len(ends)
            over += ends
        return node, over


def _gathered(src, dst, own: dict[int, int]) -> tuple[list[int], dict[int, int]]:
    """(nodes, bits): for each node the union of ``own`` over all nodes that one step or more lead to."""
    ahead = {}
    for a, b in zip(src, dst, strict=True):
        ahead.setdefault(a, []).append(b)
    order = _finished(ahead, ahead)
    bits, grown = dict.fromkeys(order, 0), True
    while grown:
        grown = False
        for v in order:
            x = bits[v]
            for to in ahead.get(v, ()):
                x |= own.get(to, 0) | bits[to]
            if x != bits[v]:
                bits[v], grown = x, True
    return order, bits


def _after(src, dst, boundary, gvar):
    names = sorted(set(gvar))
    at, own = {g: i for i, g in enumerate(names)}, {}
    for b, g in zip(boundary, gvar, strict=True):
        own[b] = own.get(b, 0) | 1 << at[g]
    order, bits = _gathered(src, dst, own)
    node, out = [], []
    for v in order:
        found = [names[i] for i in _members(bits[v])]
        node += [v] * len(found)
        out += found
    return node, out


def _round_trips(src, dst):
    nodes = {v: 1 << i for i, v in enumerate(sorted({*src, *dst}))}
    order, bits = _gathered(src, dst, nodes)
    found = [v for v in order if bits[v] & nodes[v]]
    return found, found


def on_cycles(cfg: DataFrame, scratch: Scratch, most: int = MOST_STEPS) -> DataFrame:
    """(func, node): nodes from which steps (func, src, dst) lead back to them.

    Functions of up to ``most`` steps are a row each; the others' nodes are numbered and
    their strong components found.
    """
    steps = scratch.save(cfg.select("func", "src", "dst").where("func is not null").distinct(), "cfg")
    few, many = _by_size(steps, scratch, most)
    kind = dict(steps.dtypes)["func"]
    found = _as_row(few, "src", "dst").mapInArrow(_Rows(_round_trips, "node", "same"), f"func {kind}, node long, same long").select("func", "node")
    if many is None:
        return found
    many = many.where("src is not null and dst is not null")
    nodes = many.select("func", F.col("src").alias("node")).union(many.select("func", "dst")).distinct()
    nodes = scratch.save(nodes.withColumn("n", F.monotonically_increasing_id()), "numbers")
    end = lambda c, out: nodes.select("func", F.col("node").alias(c), F.col("n").alias(out))
    wide = scratch.save(many.join(end("src", "a"), ["func", "src"]).join(end("dst", "b"), ["func", "dst"]).select(F.col("a").alias("src"), F.col("b").alias("dst")), "wide")
    loops = wide.where("src = dst").select(F.col("src").alias("n"))
    strong = strong_components(wide, scratch).where("size > 1").select(F.col("node").alias("n")).union(loops).distinct()
    return found.union(nodes.join(strong, "n").select("func", F.col("node").cast("long").alias("node")))


def dominators(cfg: DataFrame, scratch: Scratch, entry: int = 0, most: int = MOST_STEPS) -> DataFrame:
    """(func, node, dominator) for nodes that each function's ``entry`` reaches.

    A function of up to ``most`` steps is one row, whose sets of dominators are found where
    it lies.  Of larger ones, A dominates B when B cannot be reached once A is taken out, so
    the graph of each (function, A) is walked without A; all walks share their rounds.
    """
    steps = scratch.save(cfg.select("func", "src", "dst").where("func is not null").distinct(), "cfg")
    few, many = _by_size(steps, scratch, most)
    kind = dict(steps.dtypes)["func"]
    found = _as_row(few, "src", "dst").mapInArrow(_Rows(_Dominators(entry), "node", "dominator"), f"func {kind}, node long, dominator long")
    return found if many is None else found.union(_dominators_by_rounds(many, scratch, entry))


def _dominators_by_rounds(many: DataFrame, scratch: Scratch, entry: int) -> DataFrame:
    steps = scratch.save(many.where("src is not null and dst is not null"), "large-cfg")
    roots = many.select("func").distinct()
    live = roots.select("func", F.lit(entry).cast("long").alias("node"))
    live = _walk(live.withColumn("out", F.lit(None).cast("long")), steps, scratch).select("func", "node")
    live = scratch.save(live, "live")
    without = live.select("func", F.col("node").alias("out"))
    start = without.where(F.col("out") != entry).select("func", F.lit(entry).cast("long").alias("node"), "out")
    seen = _walk(start, steps, scratch)
    pairs = live.join(without, "func")
    missed = pairs.join(seen, ["func", "node", "out"], "left_anti")
    return missed.select("func", "node", F.col("out").alias("dominator"))


def _walk(start: DataFrame, steps: DataFrame, scratch: Scratch) -> DataFrame:
    """(func, node, out): nodes reached from start without entering ``out``."""
    seen = scratch.save(start.select("func", "node", "out"), "walked")
    new, edges = seen, steps.select("func", F.col("src").alias("node"), "dst")
    while not new.isEmpty():
        found = new.join(edges, ["func", "node"]).where("out is null or dst <> out").select("func", F.col("dst").alias("node"), "out").distinct()
        again = (found.func == F.col("s.func")) & (found.node == F.col("s.node")) & found.out.eqNullSafe(F.col("s.out"))
        new = scratch.save(found.join(seen.alias("s"), again, "left_anti"), "new")
        seen = scratch.grow(seen, new, "walked")
    return seen


def may_write_after(cfg: DataFrame, writes: DataFrame, scratch: Scratch, most: int = 2 * MOST_STEPS) -> DataFrame:
    """(func, boundary, gvar): globals that may still be written after a boundary.

    Backward dataflow ``after(b) = union over successors s of writes(s) and after(s)``,
    which is writes joined with the closure of the boundaries.  Functions of up to ``most`` steps
    and writes are a row each; writes of the others, and of those with a step from null, go back by rounds.
    """
    steps = scratch.save(cfg.select("func", "src", "dst").where("func is not null").distinct(), "cfg")
    gen = scratch.save(writes.select("func", F.col("boundary").alias("dst"), F.coalesce("gvar", F.lit(NO_GLOBAL)).alias("gvar")).distinct(), "gen")
    few, many = _by_size(steps, scratch, most, gen, odd=steps.where("src is null and dst is not null"))
    kind = dict(steps.dtypes)["func"]
    own = gen if many is None else gen.join(many.select("func").distinct(), "func", "left_anti")
    rows = _as_row(few, "src", "dst").hint("merge").join(_as_row(own.withColumnRenamed("dst", "boundary"), "boundary", "gvar"), "func")
    found = rows.mapInArrow(_Rows(_after, "boundary", "gvar"), f"func {kind}, boundary long, gvar long")
    found = found if many is None else found.union(_written_by_rounds(many, gen, scratch))
    return found.withColumn("gvar", F.nullif("gvar", F.lit(NO_GLOBAL)))


def _written_by_rounds(many: DataFrame, gen: DataFrame, scratch: Scratch) -> DataFrame:
    steps = scratch.save(many, "large-cfg")
    seen = scratch.save(steps.join(gen, ["func", "dst"]).select("func", F.col("src").alias("boundary"), "gvar").distinct(), "after")
    new = seen
    while not new.isEmpty():
        up = steps.join(new.withColumnRenamed("boundary", "dst"), ["func", "dst"]).select("func", F.col("src").alias("boundary"), "gvar").distinct()
        new = scratch.save(up.join(seen, ["func", "boundary", "gvar"], "left_anti"), "new")
        seen = scratch.grow(seen, new, "after")
    return seen


def distances(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(origin, node, depth, parent) for all pairs with a path of one edge or more: the length of the shortest, and of
    the nodes that come before the end on paths of that length, the least.

    A path longer than m and no longer than 2m is one of just m and one of up to m more, so each round
    doubles the length, and the pairs that are known meet log(longest path) rounds and not each of its steps.
    """
    near = edges.select(F.col("src").alias("origin"), F.col("dst").alias("node")).where("origin is not null and node is not null").distinct()
    new = seen = scratch.save(near.select("origin", "node", F.lit(1).cast("long").alias("depth"), F.col("origin").alias("parent")), "paths")
    length = 1
    while not new.isEmpty():
        far = new.where(F.col("depth") == length).select("origin", F.col("node").alias("mid"))
        rest = seen.select(F.col("origin").alias("mid"), "node", F.struct((F.col("depth") + length).alias("depth"), "parent").alias("end"))
        found = far.join(rest, "mid").groupBy("origin", "node").agg(F.min("end").alias("end"))
        new = scratch.save(found.join(seen, ["origin", "node"], "left_anti").select("origin", "node", "end.depth", "end.parent"), "longer")
        seen = scratch.grow(seen, new, "paths")
        length *= 2
    return seen


def shortest_witness(edges: DataFrame, start: DataFrame, goal: DataFrame, scratch: Scratch) -> DataFrame:
    """(origin, node, depth, parent): the shortest way from ``start`` (origin, node), for goals reached
    by one step or more; of parents at the least depth, the least.

    Where most nodes are started from, lengths of paths are doubled; else the search is breadth-first.
    """
    ends = goal.select("node").distinct()
    start = scratch.save(start.select("origin", "node").distinct(), "start")
    sources = scratch.save(edges.where("dst is not null").select(F.col("src").alias("node")).where("node is not null").distinct(), "sources")
    begun = sources.join(start.select("node").distinct(), "node", "left_semi").count()
    if 2 * begun >= sources.count():
        ways = distances(edges, scratch).join(ends, "node", "left_semi").select(F.col("origin").alias("at"), "node", F.struct("depth", "parent").alias("end"))
        rows = ways.join(start.withColumnRenamed("node", "at"), "at").groupBy("origin", "node").agg(F.min("end").alias("end"))
        return rows.select("origin", "node", "end.depth", "end.parent")
    steps = scratch.save(edges.select(F.col("src").alias("node"), "dst").distinct(), "steps")
    new, seen, depth = start, None, 0
    while not new.isEmpty():
        depth += 1
        found = new.join(steps, "node").groupBy("origin", F.col("dst").alias("to")).agg(F.min("node").alias("parent"))
        found = found.select("origin", F.col("to").alias("node"), F.lit(depth).cast("long").alias("depth"), "parent")
        fresh = found if seen is None else found.join(seen, ["origin", "node"], "left_anti")
        new = scratch.save(fresh.select("origin", "node", "depth", "parent"), "new")
        seen = new if seen is None else scratch.grow(seen, new, "seen")
    return seen.join(ends, "node", "left_semi").select("origin", "node", "depth", "parent")
