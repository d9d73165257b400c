"""Parent-child rows of unknown depth to full hierarchies.

``forest`` finds connected components by pointer doubling, puts each component
into one task and walks it depth first with node colours.  A component too large
for one task is cut into fragments that are walked in the same way, and so is
the tree of its fragments.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitempo.session import Cut

#: Components up to this many nodes are walked in one task; larger ones in fragments.
COMPONENT_ROWS = 200_000
#: Components are dealt to tasks by hash; this many nodes per task on average.
TASK_ROWS = 50_000
#: One node in so many begins a fragment, and so does every child of a node with more children than ``WIDE``.
FRAGMENT, WIDE = 256, 1000
#: Ids of paths that a task holds before it hands rows on.
HELD = 500_000
FOREST = "id string, root_id string, depth long, n_descendants long, in_loop boolean, leads_to_loop boolean, back_edge_to string"
PATH = ", path array<string>"


def plain_id(text: Column) -> Column:
    """An id without surrounding white space, whole numbers in one notation.

    ``' 12'``, ``'12.0'``, ``'+012'`` and ``'1.2E1'`` become ``'12'``; blank
    becomes null; anything else is only trimmed.
    """
    bare = F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    whole = F.regexp_replace(F.regexp_extract(bare, r"^[+-]?(\d+)(\.0*)?$", 1), "^0+(?=.)", "")
    sign = F.when(bare.startswith("-") & (whole != "0"), F.lit("-")).otherwise(F.lit(""))
    large = bare.try_cast("decimal(38,6)")
    written = F.when(bare.rlike(r"^[+-]?\d+(\.\d+)?[eE][+-]?\d+$") & (large == F.floor(large)), large.cast("decimal(38,0)").cast("string"))
    return F.when(bare == "", None).when(bare.rlike(r"^[+-]?\d+(\.0*)?$"), F.concat(sign, whole)).otherwise(F.coalesce(written, bare))


def parents(nodes: DataFrame, key: str, parent: str, plain: bool = False) -> DataFrame:
    """``(id, parent)`` with parents that exist; others (and nulls) become null.

    Ids are normalised by ``plain_id`` (those of ``key`` are already, if
    ``plain``); rows without an id are left out, of repeated ids the smallest
    parent is kept (callers choose a state first).
    """
    links = nodes.select((F.col(key) if plain else plain_id(F.col(key))).alias("id"), plain_id(F.col(parent)).alias("p")).where("id is not null")
    links = links.groupBy("id").agg(F.min("p").alias("p"))
    there = links.select(F.col("id").alias("p"), F.lit(True).alias("_there"))
    return links.join(there, "p", "left").select("id", F.when(F.col("_there"), F.col("p")).alias("parent"))


def components(links: DataFrame) -> DataFrame:
    """``(id, parent, component)``: the root's id, or the smallest id of the loop.

    Each row keeps a pointer to an ancestor, whose distance doubles every
    round, one join and one written table.  Rows leave when their pointer is a
    root; when a round lets no row go the rest all lead into loops, and
    doubling goes on until the pointers' reach is the number of these rows,
    carrying the smallest id seen.
    """
    tops = links.where("parent is null").select("id", "parent", F.col("id").alias("component"))
    rest = Cut(links.where("parent is not null").select("id", "parent", F.col("parent").alias("ptr"), F.least("id", "parent").alias("low"))).df
    done, reach, waiting, looping = [tops], 1, rest.count(), False
    at = lambda df, ptr, low, ended: df.select(F.col("id").alias("ptr"), F.col(ptr).alias("_next"), low.alias("_low"), F.lit(ended).alias("_done"))
    while waiting and not (looping and reach >= waiting):
        hop = at(rest, "ptr", F.col("low"), False)
        for d in [] if looping else done:
            hop = hop.unionByName(at(d, "component", F.lit(None).cast("string"), True))
        step = Cut(rest.join(hop, "ptr").select("id", "parent", F.col("_next").alias("ptr"), F.least("low", "_low").alias("low"), "_done")).df
        reach *= 2
        rest = step.where("not _done").drop("_done")
        if not looping:
            done.append(step.where("_done").select("id", "parent", F.col("ptr").alias("component")))
            before, waiting = waiting, rest.count()
            looping = waiting == before
    if waiting:
        # Every pointer is on its loop, and a row of a loop has seen the whole of it.
        on = rest.select(F.col("id").alias("ptr"), F.col("low").alias("component"))
        done.append(rest.drop("low").join(on, "ptr").select("id", "parent", "component"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _order(children: list[list[int]], root: int) -> Iterator[tuple[int, bool]]:
    """Nodes below and at ``root``, depth first: (node, True) on entering, (node, False) on leaving."""
    stack = [(root, 0)]
    yield root, True
    while stack:
        node, at = stack.pop()
        if at < len(children[node]):
            stack.append((node, at + 1))
            stack.append((children[node][at], 0))
            yield children[node][at], True
        else:
            yield node, False


def _family(ids: list, parent: list) -> tuple[list[int], list[list[int]]]:
    index = {v: i for i, v in enumerate(ids)}
    up = [index.get(p, -1) if p is not None else -1 for p in parent]
    children: list[list[int]] = [[] for _ in ids]
    for i, u in enumerate(up):
        if u >= 0:
            children[u].append(i)
    return up, children


def _walk(ids: list, parent: list, paths: bool) -> Iterator[tuple]:
    """Depth-first traversal of one component with white, grey and black nodes.

    Paths are told from the nodes entered and not left, so only one is held.
    """
    up, children = _family(ids, parent)
    n = len(ids)
    root = next((i for i in range(n) if up[i] < 0), None)
    if root is not None:
        depth, below, trail = [0] * n, [0] * n, []
        for node, entered in _order(children, root):
            if entered:
                depth[node] = depth[up[node]] + 1 if node != root else 0
            elif node != root:
                below[up[node]] += below[node] + 1
        for node, entered in _order(children, root):
            if not entered:
                trail and trail.pop()
                continue
            if paths:
                trail.append(ids[node])
            yield (ids[node], ids[root], depth[node], below[node], False, False, None, *([list(trail)] if paths else []))
        return
    # A component of parent links without a root has exactly one loop: climb until a node is met again.
    colour, i = [0] * n, 0
    while not colour[i]:
        colour[i], i = 1, up[i]
    loop, start = [i], i
    while up[loop[-1]] != start:
        loop.append(up[loop[-1]])
    top = min(loop, key=lambda k: ids[k])
    on, back, colour = set(loop), {}, [0] * n
    stack = [(top, 0)]
    colour[top] = 1
    while stack:
        node, at = stack.pop()
        if at == len(children[node]):
            colour[node] = 2
            continue
        stack.append((node, at + 1))
        child = children[node][at]
        if colour[child] == 1:
            back[node] = ids[child]  # an edge to a grey node closes a loop
        elif not colour[child]:
            colour[child] = 1
            stack.append((child, 0))
    for i in range(n):
        yield (ids[i], ids[top], -1, -1, i in on, i not in on, back.get(i), *([None] if paths else []))


def _walk_weighted(ids: list, parent: list, weight: list, length: list, paths: bool) -> Iterator[tuple]:
    """Depth-first traversal of a tree of fragments, or of one fragment: (id, depth, weight below, path)."""
    up, children = _family(ids, parent)
    n = len(ids)
    for root in (i for i in range(n) if up[i] < 0):
        depth, below, trail = {root: 0}, {}, []
        for node, entered in _order(children, root):
            if entered:
                below[node] = 0
                if node != root:
                    depth[node] = depth[up[node]] + length[node]
            elif node != root:
                below[up[node]] += below[node] + weight[node]
        for node, entered in _order(children, root):
            if not entered:
                trail and trail.pop()
                continue
            if paths:
                trail.append(ids[node])
            yield (ids[node], depth[node], below[node], *([list(trail)] if paths else []))


def _by_group(walk, columns: list[str], names: list[str], paths: bool):
    """Runs ``walk`` over rows that come sorted by their first column, one group at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, group, out, held = None, [[] for _ in columns], [], 0

        def told() -> Iterator[pd.DataFrame]:
            nonlocal out, held
            for row in walk(*group, paths) if group[0] else ():
                out.append(row)
                held += len(row[-1] or ()) + 10 if paths else 10
                if held > HELD:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0

        for batch in batches:
            for key, *row in batch.itertuples(index=False, name=None):
                if key != now:
                    yield from told()
                    now, group = key, [[] for _ in columns]
                for values, v in zip(group, row, strict=True):
                    values.append(None if v is None or v != v else v)
        yield from told()
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


_NODE = "id string, depth long, below long"


def _weighted(nodes: DataFrame, group: str, paths: bool, task_rows: int, rows: int) -> DataFrame:
    """``_walk_weighted`` over each group of ``nodes(group, id, parent, weight, length)``."""
    schema = _NODE + (PATH if paths else "")
    names = [c.split()[0] for c in schema.split(", ")]
    dealt = nodes.select(group, "id", "parent", "weight", "length").repartition(max(1, -(-rows // task_rows)), group).sortWithinPartitions(group, "id")
    return dealt.mapInPandas(_by_group(_walk_weighted, ["id", "parent", "weight", "length"], names, paths), schema)


def _fragments(rest: DataFrame) -> DataFrame:
    """``(id, fragment)``: each node's nearest ancestor that begins one, by pointer doubling between these."""
    now = Cut(rest.select("id", F.when(F.col("cut"), F.col("id")).otherwise(F.col("parent")).alias("ptr"), F.col("cut").alias("done")))
    while not now.df.where("not done").isEmpty():
        above = now.df.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("done").alias("_done"))
        going = now.df.where("not done").join(above, "ptr").select("id", F.col("_ptr").alias("ptr"), F.col("_done").alias("done"))
        step = Cut(now.df.where("done").unionByName(going))
        now.drop()
        now = step
    return now.df.select("id", F.col("ptr").alias("fragment"))


def _trees(nodes: DataFrame, paths: bool, bound: int, task_rows: int) -> DataFrame:
    """``(id, depth, below[, path])`` of trees of any size: ``nodes(tree, id, parent, weight, length)``.

    Trees up to ``bound`` nodes are walked whole.  Of larger ones the leaves
    are counted for their parents, the rest is cut into fragments, each walked
    by itself; then the tree of the fragments, which is many times smaller, is
    solved in the same way, and its weights and depths go back into them.
    """
    rows = nodes.count()
    if nodes.groupBy("tree").count().where(F.col("count") > bound).isEmpty():
        return _weighted(nodes, "tree", paths, task_rows, rows)
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    known = Cut(nodes.join(kids, "id", "left")).df
    leaf = F.col("kids").isNull() & F.col("parent").isNotNull()
    leaves, inner = known.where(leaf), known.where(~leaf)
    under = leaves.groupBy(F.col("parent").alias("id")).agg(F.sum("weight").alias("leaf_weight"), F.count(F.lit(1)).alias("n_leaves"))
    inner = inner.join(under, "id", "left").withColumn("leaf_weight", F.coalesce("leaf_weight", F.lit(0))).withColumn("kids", F.coalesce("kids", F.lit(0)) - F.coalesce("n_leaves", F.lit(0)))
    wide = inner.where(F.col("kids") > WIDE).select(F.col("id").alias("parent"), F.lit(True).alias("wide"))
    cut_here = F.col("parent").isNull() | (F.pmod(F.xxhash64("id"), F.lit(FRAGMENT)) == 0) | F.coalesce("wide", F.lit(False))
    inner = Cut(inner.join(wide, "parent", "left").withColumn("cut", cut_here).select("tree", "id", "parent", "weight", "length", "leaf_weight", "cut")).df
    inner = Cut(inner.join(_fragments(inner), "id")).df
    within = inner.withColumn("up", F.when(~F.col("cut"), F.col("parent"))).withColumn("whole", F.col("weight") + F.col("leaf_weight"))
    of_fragment = lambda df, weight: df.select("fragment", "id", F.col("up").alias("parent"), F.col(weight).alias("weight"), "length")
    first = Cut(_weighted(of_fragment(within, "whole"), "fragment", False, task_rows, rows)).df
    weights = within.join(first, "id")
    at = weights.select(F.col("id").alias("parent"), F.col("fragment").alias("above"), F.col("depth").alias("_depth"))
    tops = weights.where("cut").select("tree", "id", "parent", (F.col("below") + F.col("whole")).alias("weight"), "length").join(at, "parent", "left")
    tops = Cut(tops.select("tree", "id", F.col("parent").alias("joint"), F.col("above").alias("parent"), "weight", (F.col("length") + F.coalesce("_depth", F.lit(0))).alias("length"))).df
    solved = Cut(_trees(tops.drop("joint"), False, bound, task_rows)).df
    hung = tops.join(solved, "id").where("joint is not null").groupBy(F.col("joint").alias("id")).agg(F.sum(F.col("below") + F.col("weight")).alias("hung"))
    full = within.join(hung, "id", "left").withColumn("hung", F.coalesce("hung", F.lit(0))).withColumn("all", F.col("whole") + F.col("hung"))
    second = Cut(_weighted(of_fragment(full, "all"), "fragment", paths, task_rows, rows)).df
    top = solved.select(F.col("id").alias("fragment"), F.col("depth").alias("_top"))
    done = full.join(second, "id").join(top, "fragment").select("id", "fragment", (F.col("_top") + F.col("depth")).alias("depth"), (F.col("below") + F.col("leaf_weight") + F.col("hung")).alias("below"), *(["path"] if paths else []))
    if paths:
        # What stands above a fragment is the path of the node that it hangs from, by doubling over the fragments.
        joint = done.select(F.col("id").alias("joint"), F.col("fragment").alias("ptr"), F.col("path").alias("pre"))
        now = Cut(tops.select(F.col("id").alias("fragment"), "joint").join(joint, "joint", "left").select("fragment", "ptr", F.coalesce("pre", F.array().cast("array<string>")).alias("pre")))
        while not now.df.where("ptr is not null").isEmpty():
            above = now.df.select(F.col("fragment").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("pre").alias("_pre"))
            going = now.df.where("ptr is not null").join(above, "ptr").select("fragment", F.col("_ptr").alias("ptr"), F.concat("_pre", "pre").alias("pre"))
            step = Cut(now.df.where("ptr is null").unionByName(going))
            now.drop()
            now = step
        done = done.join(now.df.select("fragment", "pre"), "fragment").select("id", "fragment", "depth", "below", F.concat("pre", "path").alias("path"))
    done = Cut(done.drop("fragment")).df
    over = done.select(F.col("id").alias("parent"), F.col("depth").alias("_depth"), *([F.col("path").alias("_path")] if paths else []))
    low = leaves.join(over, "parent").select("id", (F.col("_depth") + F.col("length")).alias("depth"), F.lit(0).cast("long").alias("below"), *([F.concat("_path", F.array("id")).alias("path")] if paths else []))
    return done.unionByName(low)


def _large(part: DataFrame, paths: bool, bound: int, task_rows: int) -> DataFrame:
    """``FOREST`` of components that do not fit into one task.

    A loop is cut above its smallest node, which then is the root; the nodes
    on it are those above the node that the cut link came from.
    """
    whole = part.groupBy("component").agg(F.max(F.col("parent").isNull()).alias("_tree"))
    known = part.join(whole, "component")
    closing = known.where("not _tree and id = component").select(F.col("parent").alias("id"), F.col("id").alias("back_edge_to"))
    nodes = known.join(closing, "id", "left").select(
        F.col("component").alias("tree"), "id", F.when(F.col("_tree") | (F.col("id") != F.col("component")), F.col("parent")).alias("parent"),
        F.when(F.col("_tree"), F.lit(1)).otherwise(F.col("back_edge_to").isNotNull().cast("int")).cast("long").alias("weight"), F.lit(1).cast("long").alias("length"), "_tree", "back_edge_to",
    )
    nodes = Cut(nodes).df
    out = nodes.select("tree", "id", "weight", "_tree", "back_edge_to").join(_trees(nodes.drop("_tree", "back_edge_to"), paths, bound, task_rows), "id")
    no, on = F.lit(-1).cast("long"), ~F.col("_tree") & (F.col("below") + F.col("weight") > 0)
    return out.select(
        "id", F.col("tree").alias("root_id"), F.when(F.col("_tree"), F.col("depth")).otherwise(no).alias("depth"), F.when(F.col("_tree"), F.col("below")).otherwise(no).alias("n_descendants"),
        on.alias("in_loop"), (~F.col("_tree") & ~on).alias("leads_to_loop"), "back_edge_to", *([F.when(F.col("_tree"), F.col("path")).alias("path")] if paths else []),
    )


def forest(links: DataFrame, paths: bool = False, component_rows: int = COMPONENT_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Root, depth and number of descendants of each ``(id, parent)``, and its path if asked for.

    * ``parent`` null (or equal to no id, see ``parents``) makes a root with depth 0.
    * Rows on a loop, or leading into one, get the smallest id on the loop as
      ``root_id``, -1 as depth and n_descendants and no path; ``back_edge_to``
      marks the row whose child link closes the loop.
    * ``path`` is an array of ids from the root down to the row itself, so the
      rows take as much room as the sum of their depths.
    * An empty table gives no rows.
    """
    found = Cut(components(links)).df
    giants = found.groupBy("component").count().where(F.col("count") > component_rows).select("component")
    has_giants = not giants.isEmpty()
    normal = found.join(giants, "component", "left_anti") if has_giants else found
    tasks = max(1, -(-found.count() // task_rows))
    schema = FOREST + (PATH if paths else "")
    names = [f.split()[0] for f in schema.split(", ")]
    walked = normal.repartition(tasks, "component").sortWithinPartitions("component", "id").select("component", "id", "parent").mapInPandas(_by_group(_walk, ["id", "parent"], names, paths), schema)
    if not has_giants:
        return walked
    return walked.unionByName(_large(found.join(giants, "component", "left_semi"), paths, component_rows, task_rows))


def descendants(links: DataFrame) -> DataFrame:
    """``(ancestor_id, id, distance)`` for every node below a node of a tree.

    Every path tells the ancestors of its last node, so there are as many
    pairs as the sum of all depths.  Rows on loops or leading into them have
    no pairs.
    """
    tree = forest(links, paths=True).where("path is not null")
    up = tree.select("id", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("i", "ancestor_id"), F.size("path").alias("n"))
    return up.select("ancestor_id", "id", (F.col("n") - 1 - F.col("i")).cast("long").alias("distance"))
