"""Parent-child rows to full hierarchies by heavy-path decomposition.

Links are climbed by pointer doubling, so a tree of depth d takes about log2(d) joins whatever its shape, and no tree is
ever gathered into one task. Circles are separated first; subtree sizes choose each node's heavy child, heavy links form
chains, and paths and descendant intervals are put together from whole chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import Workspace

#: Parts at least into which the light children of one node are split for numbering, so no node's children meet in one task.
SIBLING_PARTS = 32


def normal_id(c: Column | str) -> Column:
    """A link as it is compared: trimmed, in lower case, null if blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, r"^[\s\u00a0\u200b\ufeff]+|[\s\u00a0\u200b\ufeff]+$", "")), F.lit(""))


def resolve_links(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", fallback_col: str | None = "seed_id") -> DataFrame:
    """(id, parent): parent is the row named by parent_col, or by fallback_col where parent_col is null or blank.

    Rows with a null id are left out. A repeated id counts once; if its copies name different parents, the smallest
    name holds. A name that no row has gives a null parent. Other columns, whatever their names, are not read.
    """
    up = normal_id(parent_col)
    if fallback_col is not None:
        up = F.coalesce(up, normal_id(fallback_col))
    nodes = df.select(F.col(id_col).cast("string").alias("id"), up.alias("up")).where("id is not null").groupBy("id").agg(F.min("up").alias("up"))
    known = nodes.select(F.col("id").alias("parent"))
    return nodes.join(known, nodes["up"] == known["parent"], "left").select("id", "parent")


def climb(ws: Workspace, nodes: DataFrame, sums: tuple[str, ...] = (), text: str | None = None, sizes: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Follows `up` from every node to the top, doubling the step each round.

    nodes: (id, up, *sums, text), up null or the id of a node. Returns the nodes that arrive: (id, up, hops, top, *sums, text[, size]) with
    sums added up and text joined, topmost first, along the way, size counting a node and all below it; those that never do, as they
    hang on a circle: (id, up, ptr), ptr some steps up; and the number of these. Ends when a round lets no further node arrive: as
    every ancestor of a node that arrives late arrives earlier, the rest then cannot arrive at all. A round reads and writes only
    nodes that still wait; they look up where those are that they have come to, and once they are few they are what is sent around.
    """
    up = F.col("up")
    cols = ["id", "up", up.alias("ptr"), up.isNotNull().cast("long").alias("hops"), F.when(up.isNull(), F.col("id")).alias("top"), *sums]
    cols += ([text] if text else []) + ([F.lit(1).cast("long").alias("size")] if sizes else [])
    state, got = ws.write(nodes.select(*cols), left=F.count("ptr"))
    parts, left, before = [state], got["left"] or 0, None
    while left and left != before:
        waiting = parts[-1].where("ptr is not null")
        at = ws.together(parts).where("ptr is null").unionByName(waiting)
        at = at.select(*[F.col(c).alias(f"t_{c}") for c in ("id", "ptr", "hops", "top", *sums, *([text] if text else []))])
        new = waiting.join(at, F.col("ptr") == F.col("t_id"))
        if sizes:
            more = waiting.groupBy(F.col("ptr").alias("m_id")).agg(F.sum("size").alias("more"))
            new = new.join(more, F.col("id") == F.col("m_id"), "left")
        added = [(F.col(c) + F.col(f"t_{c}")).alias(c) for c in ("hops", *sums)]
        joined = [F.concat_ws("/", f"t_{text}", text).alias(text)] if text else []
        size = [(F.col("size") + F.coalesce("more", F.lit(0))).alias("size")] if sizes else []
        new, got = ws.write(new.select("id", "up", F.col("t_ptr").alias("ptr"), *added[:1], F.col("t_top").alias("top"), *added[1:], *joined, *size), left=F.count("ptr"))
        parts.append(new)
        left, before = got["left"] or 0, left
    arrived = ws.together(parts).where("ptr is null").drop("ptr")
    if sizes:
        # What the nodes below brought in, round by round: each node of a part counted, with those it had counted, for the node it pointed to.
        brought = ws.together(parts).where("ptr is not null").groupBy(F.col("ptr").alias("b_id")).agg(F.sum("size").alias("brought"))
        arrived = arrived.drop("size").join(brought, F.col("id") == F.col("b_id"), "left").withColumn("size", 1 + F.coalesce("brought", F.lit(0))).drop("b_id", "brought")
    return arrived, parts[-1].where("ptr is not null").select("id", "up", "ptr"), left


def circles(ws: Workspace, stuck: DataFrame) -> DataFrame:
    """(id, circle) of the nodes that lie on circles, circle being the smallest id on it.

    stuck: (id, up, ptr) of all nodes that lead into circles, ptr some steps up. The images of ever longer steps shrink to
    exactly the nodes on circles: once a doubling leaves their number unchanged, the step permutes them.
    """
    state, got = ws.write(stuck.select("id", "up", "ptr"))
    n = state.agg(F.countDistinct("ptr")).first()[0]
    while True:
        at = state.select(F.col("id").alias("t_id"), F.col("ptr").alias("t_ptr"))
        new, _ = ws.write(state.join(at, state["ptr"] == at["t_id"]).select("id", "up", F.col("t_ptr").alias("ptr")))
        m = new.agg(F.countDistinct("ptr")).first()[0]
        if m == n:
            break
        ws.drop(state)
        state, n = new, m
    on = state.select(F.col("ptr").alias("c")).distinct()
    least, _ = ws.write(state.join(on, state["id"] == on["c"], "left_semi").select("id", F.col("up").alias("ptr"), F.least("id", "up").alias("circle")))
    while True:
        at = least.select(F.col("id").alias("t_id"), F.col("ptr").alias("t_ptr"), F.col("circle").alias("t_circle"))
        new = least.join(at, least["ptr"] == at["t_id"]).select("id", F.col("t_ptr").alias("ptr"), F.least("circle", "t_circle").alias("circle"), (F.col("t_circle") != F.col("circle")).alias("differs"))
        new, got = ws.write(new, differ=F.count_if("differs"))
        ws.drop(least)
        least = new.drop("differs")
        least._weftline_path = new._weftline_path
        if not got["differ"]:
            return least.select("id", "circle")


def label(links: DataFrame) -> DataFrame:
    """Labels every node of links (id, parent), parent null or the id of a row.

    Columns: id, parent, root_id (topmost ancestor; the smallest id on the circle that the way up enters), depth (links up to
    the root or the circle), on_circle, tree_parent (null at roots, on circles and just below circles), top (root of the
    separated tree), size (nodes at and below; null on circles), head and pos (chain and place on it), first (number in
    depth-first order within top, heavy children first: the descendants of v are those with the same top and first in
    v.first+1 .. v.first+v.size-1). Subtree sizes choose each node's heavy child, heavy links make chains, and root, depth and first
    come from the chain heads on the way up.
    """
    ws = Workspace(links.sparkSession, "hierarchy")
    free, rest, stuck = climb(ws, links.select("id", F.col("parent").alias("up")), sizes=True)
    nodes = free.select("id", F.col("up").alias("parent"), F.col("up").alias("tree_parent"), "size", F.lit(None).cast("string").alias("circle"))
    if stuck:
        on = circles(ws, rest)
        enter = on.select(F.col("id").alias("c_id"), "circle")
        ring = rest.join(on, "id").select("id", F.col("up").alias("parent"), F.lit(None).cast("string").alias("tree_parent"), F.lit(None).cast("long").alias("size"), "circle")
        tail = rest.join(on, "id", "left_anti").join(enter, F.col("up") == F.col("c_id"), "left")
        tail, _ = ws.write(tail.select("id", F.col("up").alias("parent"), F.when(F.col("circle").isNull(), F.col("up")).alias("tree_parent"), "circle"))
        below, _, _ = climb(ws, tail.select("id", F.col("tree_parent").alias("up")), sizes=True)
        nodes = nodes.unionByName(ring).unionByName(tail.join(below.select("id", "size"), "id"))
    nodes, _ = ws.write(nodes)
    kids = nodes.where("tree_parent is not null")
    heavy = kids.groupBy("tree_parent").agg(F.max(F.struct("size", "id")).alias("h")).select(F.col("tree_parent").alias("p"), F.col("h.id").alias("heavy"), F.col("h.size").alias("heavy_size"))
    # Whether a node continues its parent's chain; each node meets its parent's row once. AQE splits the parents with many children.
    marked, _ = ws.write(nodes.join(heavy, nodes["tree_parent"] == heavy["p"], "left").drop("p").withColumn("on_chain", F.coalesce(F.col("heavy") == F.col("id"), F.lit(False))).drop("heavy"))
    lines, _, _ = climb(ws, marked.select("id", F.when(F.col("on_chain"), F.col("tree_parent")).alias("up")))
    lines, _ = ws.write(lines.select("id", F.col("top").alias("head"), F.col("hops").alias("pos")))
    # Places of light children: running sizes within a part of the children, after the sums of the parts before it.
    parts = max(SIBLING_PARTS, 4 * int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    light = marked.where("tree_parent is not null and not on_chain").select("id", "tree_parent", "size", "heavy_size", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    sums = light.groupBy("tree_parent", "part").agg(F.sum("size").alias("total"))
    before = sums.withColumn("before", F.sum("total").over(Window.partitionBy("tree_parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("total")
    run = F.sum("size").over(Window.partitionBy("tree_parent", "part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    light = light.withColumn("run", run).join(before, ["tree_parent", "part"]).select("id", "tree_parent", (1 + F.col("heavy_size") + F.coalesce("run", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("offset"))
    at = lines.select(F.col("id").alias("a_id"), F.col("head").alias("a_head"), F.col("pos").alias("a_pos"))
    light = light.join(at, light["tree_parent"] == at["a_id"]).select("id", F.col("a_head").alias("up"), (F.col("offset") + F.col("a_pos")).alias("start"), (F.col("a_pos") + 1).alias("deep"), F.lit(None).cast("string").alias("circle"), F.lit(False).alias("on_circle"))
    # A tree that hangs below a circle is one link deeper; a node on a circle is its own head.
    ringed = F.col("circle").isNotNull() & F.col("size").isNull()
    deep = (F.col("circle").isNotNull() & ~ringed).cast("long")
    heads, _ = ws.write(light.unionByName(marked.where("tree_parent is null").select("id", F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("start"), deep.alias("deep"), "circle", ringed.alias("on_circle"))))
    starts, _, _ = climb(ws, heads.select("id", "up", "start", "deep"), sums=("start", "deep"))
    starts = starts.select(F.col("id").alias("head"), "top", "start", "deep")
    if stuck:
        rings = heads.where("circle is not null").select(F.col("id").alias("top"), "circle", "on_circle")
        starts = starts.join(rings, "top", "left")
    else:
        starts = starts.withColumns({"circle": F.lit(None).cast("string"), "on_circle": F.lit(False)})
    placed = lines.join(starts, "head").select("id", "head", "pos", "top", F.coalesce("circle", "top").alias("root_id"), (F.col("deep") + F.col("pos")).alias("depth"), F.coalesce("on_circle", F.lit(False)).alias("on_circle"), (F.col("start") + F.col("pos")).alias("first"))
    return marked.select("id", "parent", "tree_parent", "size").join(placed, "id").select("id", "parent", "root_id", "depth", "on_circle", "tree_parent", "top", "size", "head", "pos", "first")


def paths(labels: DataFrame) -> DataFrame:
    """(id, path): ids from the root of the separated tree down to the node, joined by '/', chain segment by chain segment.

    A path below a circle starts at the topmost node off the circle; a node on a circle has itself as path. Segments are put
    together by doubling along their chain, so that no chain is gathered.
    """
    ws = Workspace(labels.sparkSession, "paths")
    nodes, _ = ws.write(labels.select("id", "head", "pos", "tree_parent"))
    part, _, _ = climb(ws, nodes.select("id", F.when(F.col("pos") > 0, F.col("tree_parent")).alias("up"), F.col("id").alias("part")), text="part")
    part, _ = ws.write(part.select("id", F.col("top").alias("head"), "part"))
    heads = nodes.where("pos = 0").select("id", "tree_parent")
    above = part.select(F.col("id").alias("a_id"), F.col("head").alias("up"), F.col("part").alias("lead"))
    lead, _, _ = climb(ws, heads.join(above, F.col("tree_parent") == F.col("a_id"), "left").select("id", "up", F.coalesce("lead", F.lit("")).alias("lead")), text="lead")
    lead = lead.select(F.col("id").alias("head"), F.regexp_replace("lead", "^/", "").alias("lead"))
    return part.join(lead, "head").select("id", F.concat_ws("/", F.nullif("lead", F.lit("")), "part").alias("path"))


def descendants(labels: DataFrame, wanted: DataFrame | None = None, width: int = 4096) -> DataFrame:
    """(id, descendant_id, distance) of all nodes, or of those whose id is in wanted.

    Each asked node covers an interval of `first` numbers; intervals are cut at multiples of width, so that a large tree is
    spread over many tasks and each row meets only the intervals over its own stretch.
    """
    ask = labels.where("size > 1")
    if wanted is not None:
        ask = ask.join(wanted.select("id").distinct(), "id", "left_semi")
    lo, hi = F.col("first") + 1, F.col("first") + F.col("size") - 1
    ask = ask.select(F.col("id").alias("a"), "top", F.col("depth").alias("a_depth"), lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))).alias("bin"))
    rows = labels.where("not on_circle").select(F.col("id").alias("descendant_id"), "top", "depth", "first", F.floor(F.col("first") / width).alias("bin"))
    return ask.join(rows, ["top", "bin"]).where("first between lo and hi").select(F.col("a").alias("id"), "descendant_id", (F.col("depth") - F.col("a_depth")).alias("distance"))


def ring_members(labels: DataFrame) -> DataFrame:
    """(circle, member, via, depth, on_circle): each row on a circle or hanging below one, with the row of the circle its way up enters (via) and its distance from that row."""
    on = labels.where("on_circle").select(F.col("root_id").alias("circle"), F.col("id").alias("via"))
    ring = on.select("circle", F.col("via").alias("member"), "via", F.lit(0).cast("long").alias("depth"), F.lit(True).alias("on_circle"))
    tops = labels.where("not on_circle and tree_parent is null and parent is not null").select("top", F.col("parent").alias("via"))
    hang = labels.where("not on_circle").join(tops, "top").select(F.col("root_id").alias("circle"), F.col("id").alias("member"), "via", "depth", F.lit(False).alias("on_circle"))
    return ring.unionByName(hang)


def ring_descendants(labels: DataFrame) -> DataFrame:
    """(id, descendant_id, distance, on_circle) of all nodes on circles: their fellows on the circle, marked by on_circle, and all rows hanging below it.

    The other half of descendants(). Distances go down the links: places on a circle are counted from its smallest id.
    """
    ws = Workspace(labels.sparkSession, "rings")
    ring, _ = ws.write(labels.where("on_circle").select("id", "parent", "root_id"))
    place, _, _ = climb(ws, ring.select("id", F.when(F.col("id") != F.col("root_id"), F.col("parent")).alias("up")))
    place = place.select("id", F.col("top").alias("circle"), F.col("hops").alias("place"))
    length = place.groupBy("circle").agg(F.count("*").alias("length"))
    via = place.select(F.col("id").alias("via"), F.col("place").alias("via_place"))
    below = ring_members(labels).join(via, "via").join(length, "circle")
    steps = F.col("depth") + F.pmod(F.col("via_place") - F.col("place"), F.col("length"))
    return place.join(below, "circle").where("id <> member").select("id", F.col("member").alias("descendant_id"), steps.alias("distance"), "on_circle")


def ring_sizes(labels: DataFrame) -> DataFrame:
    """(id, circle, n_on_circle, n_descendants) of all nodes on circles, fellows on the circle among the descendants."""
    sizes = ring_members(labels).groupBy("circle").agg(F.count_if("on_circle").alias("n_on_circle"), (F.count("*") - 1).alias("n_descendants"))
    return labels.where("on_circle").select("id", F.col("root_id").alias("circle")).join(sizes, "circle").select("id", "circle", "n_on_circle", "n_descendants")
