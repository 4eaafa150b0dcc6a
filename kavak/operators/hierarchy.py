"""Parent-child links to full hierarchies: paths, depths, roots, descendants and loops.

Nested sets.  Nodes whose children are all done pass their subtree's size to
their parent, leaves first; what is never done lies on a loop.  Going down,
each child gets a range of preorder numbers: its parent's number plus the sizes
of the siblings before it (a prefix sum).  A node's descendants are then the
numbers of its range, its ancestors the ranges that hold its number.  A loop is
opened: its nodes are roots of their own trees, and the loop's other nodes come
as further ancestors.

A group (a plan, a forest) is worked on as a whole in one task while it has at
most ``WHOLE`` nodes.  Larger groups, and groups in which a node has several
parents, take ancestor doubling over joins, which no single task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kavak.plans.lineage import written

#: Nodes of a group up to which one task holds it.
WHOLE = 50_000
#: Ancestor pairs, or names on paths, written at once.
AT_ONCE = 1_000_000


class Forest:
    """Nested sets of one group; ``parent`` holds the parent's place, -1 for none."""

    def __init__(self, parent: np.ndarray) -> None:
        n = len(parent)
        self.parent = parent
        left = np.bincount(parent[parent >= 0], minlength=n)
        self.size = np.ones(n, np.int64)
        done = np.zeros(n, bool)
        level = np.flatnonzero(left == 0)
        levels = []
        while len(level):
            levels.append(level)
            done[level] = True
            up = level[parent[level] >= 0]
            np.add.at(self.size, parent[up], self.size[up])
            np.subtract.at(left, parent[up], 1)
            tops = np.unique(parent[up])
            level = tops[left[tops] == 0]
        self.looped = ~done
        # downwards: roots and loop nodes first, then level by level from the top
        top = np.flatnonzero(self.looped | (parent < 0))
        self.depth = np.zeros(n, np.int64)
        self.number = np.zeros(n, np.int64)
        self.root = np.arange(n)
        self.number[top] = np.cumsum(self.size[top]) - self.size[top]
        child = np.flatnonzero(~self.looped & (parent >= 0))
        child = child[np.argsort(parent[child], kind="stable")]
        first = np.searchsorted(parent[child], np.arange(n))
        last = np.searchsorted(parent[child], np.arange(n), "right")
        before = np.concatenate(([0], np.cumsum(self.size[child])))
        level = top
        while len(level):
            many = last[level] - first[level]
            owner = np.repeat(level, many)
            spot = np.repeat(first[level] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            kids = child[spot]
            self.number[kids] = self.number[owner] + 1 + before[spot] - before[first[owner]]
            self.depth[kids] = self.depth[owner] + 1
            self.root[kids] = self.root[owner]
            level = kids
        self.order = np.argsort(self.number)

    def loops(self) -> list[list[int]]:
        """The loops, each from a node to its parent, its parent's parent and so on."""
        out, seen = [], np.zeros(len(self.parent), bool)
        for i in np.flatnonzero(self.looped).tolist():
            loop = []
            while not seen[i]:
                seen[i] = True
                loop.append(i)
                i = int(self.parent[i])
            if loop:
                out.append(loop)
        return out

    def ancestors(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ancestor, node, steps) of every pair, in parts of bounded size."""
        own = np.flatnonzero(self.size > 1)
        sums = np.cumsum(self.size[own] - 1)
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + AT_ONCE, "right")))
            part = own[at:to]
            many = self.size[part] - 1
            above = np.repeat(part, many)
            below = self.order[np.repeat(self.number[part] + 1 - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
            yield above, below, self.depth[below] - self.depth[above]
            at = to
        for loop in self.loops():
            k = len(loop)
            for i, node in enumerate(loop):
                tree = self.order[self.number[node] : self.number[node] + self.size[node]]
                for step in range(1, k + 1):
                    held = tree if step < k else tree[:1]  # a loop node is its own ancestor once around
                    yield np.full(len(held), loop[(i + step) % k]), held, self.depth[held] + step


def _group(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Scalar, list[str], Forest]:
    """(the group, its names in order, its forest)."""
    whole = pa.Table.from_batches(list(batches)).sort_by("node")
    names = whole["node"].to_pylist()
    place = {x: i for i, x in enumerate(names)}
    parent = np.fromiter((place.get(p, -1) if p is not None else -1 for p in whole["parent"].to_pylist()), np.int64, len(names))
    return whole["group"][0], names, Forest(parent)


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, names, forest = _group(batches)
    held = pa.array(names, pa.string())
    for above, below, steps in forest.ancestors():
        for at in range(0, len(above), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            a, b = pa.array(above[part]), pa.array(below[part])
            yield pa.RecordBatch.from_arrays([pa.repeat(group, len(a)), held.take(a), held.take(b), pa.array(steps[part].astype(np.int32))], ["group", "ancestor", "node", "steps"])


def _nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, names, forest = _group(batches)
    n, held = len(names), pa.array(names, pa.string())
    below = forest.size - 1
    for loop in forest.loops():
        below[loop] = forest.size[loop].sum()
    above = np.where(forest.looped, -1, forest.parent)
    signs = np.cumsum(forest.depth + 1)
    at = 0
    while at < n:
        # a path is as long as its node is deep; so many of their names at once
        to = max(at + 1, int(np.searchsorted(signs, (signs[at - 1] if at else 0) + AT_ONCE, "right")))
        part = np.arange(at, to)
        ends = np.cumsum(forest.depth[part] + 1)
        path = np.zeros(int(ends[-1]), np.int64)
        spot, node, todo = ends - 1, part, np.arange(len(part))
        while len(todo):
            path[spot[todo]] = node
            spot = spot - 1
            node = above[node]
            up = node >= 0
            node, todo = node[up], todo[up]
        paths = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), held.take(pa.array(path)))
        root, looped, number = forest.root[part], forest.looped[part], forest.number[part]
        columns = [pa.repeat(group, len(part)), held.take(pa.array(part)), paths, pa.array(forest.depth[part].astype(np.int32)), held.take(pa.array(root)), pa.array(number)]
        columns += [pa.array(number + forest.size[part] - 1), pa.array(below[part]), pa.array(looped), pa.array(forest.looped[root] & ~looped)]
        yield pa.RecordBatch.from_arrays(columns, ["group", "node", "path", "depth", "root", "first", "last", "descendants", "looped", "below_loop"])
        at = to


def _dealt(rows: DataFrame) -> DataFrame:
    """Whole groups over as many tasks as there are cores for: they are little data and much work."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), "group")


def linked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(group, node, parent, n, parents)``: each node with each parent found among its group's nodes.

    ``nodes`` has ``group, node``; ``edges`` has ``group, parent, child``.
    Repeated nodes and edges count once; null names and edges to names that the
    group lacks are none.  ``n`` is the group's nodes, ``parents`` the most
    parents of a node.
    """
    nodes = nodes.filter(F.col("group").isNotNull() & F.col("node").isNotNull()).select("group", "node").distinct()
    held = edges.select("group", F.col("parent").alias("node"), "child").distinct().join(nodes, ["group", "node"], "left_semi")
    held = held.select("group", F.col("node").alias("parent"), F.col("child").alias("node"))
    out = nodes.join(held, ["group", "node"], "left")
    counts = out.groupBy("group", "node").agg(F.count("parent").alias("p")).groupBy("group").agg(F.count("*").alias("n"), F.max("p").alias("parents"))
    return out.join(counts, "group")


def ancestors(nodes: DataFrame, edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """``(group, ancestor, node, steps)``: every node with each ancestor over one or more parents, with the fewest steps.

    A node on a loop is its own ancestor, steps being the loop's length.  Input
    as for :func:`linked`; empty tables give no rows.
    """
    rows = written(linked(nodes, edges), "linked")
    kind = rows.schema["group"].dataType.simpleString()
    small = (F.col("n") <= whole) & (F.col("parents") <= 1)
    forests = rows.filter(small).select("group", "node", "parent")
    near = _dealt(forests).groupBy("group").applyInArrow(_pairs_of, f"group {kind}, ancestor string, node string, steps int")
    rest = rows.filter(~small & F.col("parent").isNotNull())
    if rest.isEmpty():
        return near
    return near.union(_doubled(rest.select("group", F.col("parent").alias("ancestor"), "node")))


def _doubled(edges: DataFrame) -> DataFrame:
    """All ancestor pairs by joining what is known with itself until nothing is new; rounds: log2 of the longest way."""
    known = written(edges.distinct().withColumn("steps", F.lit(1)), "ways")
    while True:
        up = known.select("group", F.col("node").alias("mid"), "ancestor", F.col("steps").alias("more"))
        longer = known.select("group", F.col("ancestor").alias("mid"), "node", "steps").join(up, ["group", "mid"]).select("group", "ancestor", "node", (F.col("steps") + F.col("more")).alias("steps"))
        new = written(known.union(longer).groupBy("group", "ancestor", "node").agg(F.min("steps").cast("int").alias("steps")), "ways")
        changed = new.join(known, ["group", "ancestor", "node", "steps"], "left_anti")
        if changed.isEmpty():
            return new
        known = new


def hierarchy(nodes: DataFrame, edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """Each node's place: ``group, node, path, depth, root, first, last, descendants, looped, below_loop``.

    ``first`` and ``last`` are the node's range of preorder numbers in its
    group.  A loop node starts a path of its own (depth 0); ``descendants`` of a
    loop node counts all that the loop leads to, itself included.  Siblings, and
    the roots and loop nodes of a group, are numbered by name.  Groups too large
    for one task get the same by joins.  Groups with several parents at a node
    have no preorder: their ranges are null, their depth, root and descendants
    come from :func:`ancestors`, and their path names all ancestors, loops
    included, farthest first.
    """
    rows = written(linked(nodes, edges), "linked")
    kind = rows.schema["group"].dataType.simpleString()
    small = (F.col("n") <= whole) & (F.col("parents") <= 1)
    schema = f"group {kind}, node string, path array<string>, depth int, root string, first long, last long, descendants long, looped boolean, below_loop boolean"
    near = _dealt(rows.filter(small).select("group", "node", "parent")).groupBy("group").applyInArrow(_nodes_of, schema)
    rest = rows.filter(~small)
    if rest.isEmpty():
        return near
    all_nodes = rest.select("group", "node", (F.col("parents") <= 1).alias("one")).distinct()
    ways = _doubled(rest.filter(F.col("parent").isNotNull()).select("group", F.col("parent").alias("ancestor"), "node"))
    looped = ways.filter(F.col("ancestor") == F.col("node")).select("group", "node").withColumn("looped", F.lit(True))
    on_loop = looped.select("group", F.col("node").alias("ancestor"), F.lit(True).alias("hot"))
    stops = ways.join(on_loop, ["group", "ancestor"]).groupBy("group", "node").agg(F.min("steps").alias("stop"))
    ways_up = ways.join(stops, ["group", "node"], "left").join(all_nodes, ["group", "node"])
    # a single way up ends at the nearest loop node; with several parents all loop nodes count
    opened = written(ways_up.join(looped, ["group", "node"], "left").filter(F.col("looped").isNull() & (~F.col("one") | F.col("stop").isNull() | (F.col("steps") <= F.col("stop")))), "opened")
    ups = opened.groupBy("group", "node").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("d"), "ancestor"))).alias("up"),
        F.max("steps").alias("depth"), F.max_by("ancestor", "steps").alias("top"), F.max(F.col("stop").isNotNull()).alias("hot"),
    )
    downs = ways.groupBy("group", F.col("ancestor").alias("node")).agg(F.count("*").alias("descendants"))
    far = all_nodes.join(ups, ["group", "node"], "left").join(_ranges(all_nodes.filter("one"), opened.filter("one")), ["group", "node"], "left").join(downs, ["group", "node"], "left").join(looped, ["group", "node"], "left")
    is_loop = F.coalesce("looped", F.lit(False))
    far = far.select(
        "group",
        "node",
        F.when(is_loop | F.col("up").isNull(), F.array("node")).otherwise(F.concat(F.transform("up", lambda x: x["ancestor"]), F.array("node"))).alias("path"),
        F.when(is_loop, F.lit(0)).otherwise(F.coalesce("depth", F.lit(0))).cast("int").alias("depth"),
        F.when(is_loop, F.col("node")).otherwise(F.coalesce("top", "node")).alias("root"),
        "first",
        "last",
        F.coalesce("descendants", F.lit(0)).cast("long").alias("descendants"),
        is_loop.alias("looped"),
        (F.coalesce("hot", F.lit(False)) & ~is_loop).alias("below_loop"),
    )
    return near.union(far)


def _ranges(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """``(group, node, first, last)`` of trees whose ancestor pairs are ``ways``: the sum of the places among siblings along the way up."""
    sizes = ways.groupBy("group", F.col("ancestor").alias("node")).agg(F.count("*").alias("below"))
    parents = ways.filter("steps = 1").select("group", "node", F.col("ancestor").alias("parent"))
    sized = nodes.select("group", "node").join(sizes, ["group", "node"], "left").join(parents, ["group", "node"], "left").withColumn("size", F.coalesce("below", F.lit(0)) + 1)
    before = F.sum("size").over(Window.partitionBy("group", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    local = written(sized.select("group", "node", "size", (before + F.col("parent").isNotNull().cast("long")).alias("step")), "siblings")
    above = ways.join(local.select("group", F.col("node").alias("ancestor"), "step"), ["group", "ancestor"]).groupBy("group", "node").agg(F.sum("step").alias("above"))
    first = F.col("step") + F.coalesce("above", F.lit(0))
    return local.join(above, ["group", "node"], "left").select("group", "node", first.alias("first"), (first + F.col("size") - 1).alias("last"))


def named_edges(rows: DataFrame, group: str, node: str, befores: str, afters: str, own_prefix: str = "AYT ", other_prefix: str = "TYT ") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of rows that name their predecessors and successors in two string arrays.

    Blanks at the ends and doubled blanks don't count; ``own_prefix`` may be
    left out; names with ``other_prefix`` make no edge.  The node keeps the
    least of its spellings as they stand in ``node`` (blanks aside).
    """

    def tidy(c):
        return F.trim(F.regexp_replace(c, r"[\s\x{00A0}]+", " "))

    def key(c):
        return F.regexp_replace(tidy(c), f"^{own_prefix.strip()} ", "")

    flat = rows.select(F.col(group).alias("group"), key(F.col(node)).alias("node"), F.col(befores).alias("b"), F.col(afters).alias("a"))
    nodes = flat.select("group", "node").filter(F.col("node") != "").distinct()
    other = f"^{other_prefix.strip()} "
    ups = flat.select("group", F.explode("b").alias("raw"), F.col("node").alias("child")).filter(~tidy(F.col("raw")).rlike(other)).select("group", key(F.col("raw")).alias("parent"), "child")
    downs = flat.select("group", F.col("node").alias("parent"), F.explode("a").alias("raw")).filter(~tidy(F.col("raw")).rlike(other)).select("group", "parent", key(F.col("raw")).alias("child"))
    return nodes, ups.union(downs).filter(F.col("parent").isNotNull() & F.col("child").isNotNull())
