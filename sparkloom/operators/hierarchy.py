"""Problem 4: parent-child links to full hierarchies, by tree contraction.

A round rakes every leaf and splices out an independent set of the nodes inside unary chains, so a tree, however deep,
is gone after a number of rounds that grows with the logarithm of its size.  The recorded contractions are then undone
in reverse order, which gives roots, depths and paths.  A ring shrinks to a node that is its own parent: what does not
contract to nothing has a circle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from .skew import salted_join

KEY = ["kind", "node"]


def _degrees(edges: DataFrame) -> DataFrame:
    up = edges.select("kind", F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = edges.select("kind", F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    return up.unionByName(down).groupBy(*KEY).agg(F.sum("up").alias("up"), F.sum("down").alias("down"))


def _mark(edges: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """The degrees of one end of each edge; a node may hold many edges, so the join is salted on the other end."""
    other = "parent" if side == "child" else "child"
    right = nodes.select("kind", F.col("node").alias(side), F.col("up").alias(f"{side}_up"), F.col("down").alias(f"{side}_down"))
    return salted_join(edges, right, ["kind", side], [other])


def _coin(node: Column, turn: int) -> Column:
    return F.xxhash64(node, F.lit(turn))


def contract(edges: DataFrame, both_ends: bool) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame], DataFrame | None]:
    """Rake and compress ``edges`` (kind, child, parent, via) until nothing changes.

    Returns per round the raked edges, the spliced nodes (kind, node, child, parent, via) and the nodes found to be
    their own parent, and the edges that could not be contracted (None if there are none).  ``via`` lists the nodes
    already spliced out between child and parent.  With ``both_ends`` nodes without parents are raked too, which is
    enough to find circles in graphs with several parents a node.
    """
    raked, spliced, loops = [], [], []
    left = cut_lineage(edges.select("kind", "child", "parent", "via"))
    turn, n = 0, left.count()
    while n:
        own = left.where(F.col("child") == F.col("parent"))
        loops.append(own.select("kind", F.col("child").alias("node")).distinct())
        open_ = left.where(F.col("child") != F.col("parent"))
        marked = cut_lineage(_mark(_mark(open_, _degrees(open_), "child"), _degrees(open_), "parent"))
        leaf = F.col("child_down") == 0
        root = (F.col("parent_up") == 0) if both_ends else F.lit(False)
        raked.append(marked.where(leaf | root).select("kind", "child", "parent", "via"))
        core = marked.where(~(leaf | root))
        # an inner node of a chain: one edge down, one up
        low = core.where("parent_up = 1 AND parent_down = 1").select("kind", F.col("parent").alias("node"), "child", F.col("via").alias("via_low"), (F.expr("child_up = 1 AND child_down = 1")).alias("child_inner"))
        high = core.where("child_up = 1 AND child_down = 1").select("kind", F.col("child").alias("node"), "parent", F.col("via").alias("via_high"), (F.expr("parent_up = 1 AND parent_down = 1")).alias("parent_inner"))
        mine = _coin(F.col("node"), turn)
        free = (~F.col("child_inner") | (mine > _coin(F.col("child"), turn))) & (~F.col("parent_inner") | (mine > _coin(F.col("parent"), turn)) | (F.col("parent") == F.col("child")) & (mine > _coin(F.col("child"), turn)))
        out = cut_lineage(low.join(high, KEY).where(free))
        spliced.append(out.select("kind", "node", "child", "parent", F.col("via_high").alias("via")))
        gone_low = out.select("kind", F.col("node").alias("parent"), "child")
        gone_high = out.select("kind", F.col("node").alias("child"), "parent")
        kept = core.select("kind", "child", "parent", "via").join(gone_low, ["kind", "child", "parent"], "left_anti").join(gone_high, ["kind", "child", "parent"], "left_anti")
        new = out.select("kind", "child", "parent", F.concat("via_low", F.array("node"), "via_high").alias("via"))
        after = kept.unionByName(new)
        if both_ends:
            after = after.dropDuplicates(["kind", "child", "parent"])
        left = cut_lineage(after)
        m = left.count()
        if m == n and left.where(F.col("child") == F.col("parent")).isEmpty() and out.isEmpty() and raked[-1].isEmpty():
            return raked, spliced, loops, left
        n, turn = m, turn + 1
    return raked, spliced, loops, None


def _spread_up(labels: DataFrame, edges: DataFrame, how) -> DataFrame:
    """``labels`` (kind, node, label) after every node has taken the ``how`` (an aggregate) of its own label and those
    of the nodes with an edge to it, again and again until nothing changes; a round reads each edge once."""
    while True:
        came = edges.join(labels.select("kind", F.col("node").alias("child"), "label"), ["kind", "child"]).select("kind", F.col("parent").alias("node"), "label")
        new = cut_lineage(labels.select(*KEY, "label", F.col("label").alias("_was")).unionByName(came.withColumn("_was", F.lit(None).cast("string"))).groupBy(*KEY).agg(how("label").alias("label"), F.max("_was").alias("_was")))
        if new.where(~F.col("label").eqNullSafe(F.col("_was"))).isEmpty():
            return new.select(*KEY, "label")
        labels = new.select(*KEY, "label")


def _components(core: DataFrame) -> DataFrame:
    """kind, node, ring of the nodes on circles of what could not be contracted.

    Forward-backward reachability: the greatest name spreads along the edges, which colours each node with the
    greatest name that reaches it; the nodes of a colour that in turn reach the node so named are its circle.  They are
    taken out, edges between colours are dropped, and the rest goes on.  No pairs of nodes are made, so a dense core
    costs its edges once a round.
    """
    left = cut_lineage(core.select("kind", "child", "parent").where("child <> parent").distinct())
    found = []
    while not left.isEmpty():
        ends = left.select("kind", F.explode(F.array("child", "parent")).alias("node")).distinct()
        colour = cut_lineage(_spread_up(ends.withColumn("label", F.col("node")), left, F.max).withColumnRenamed("label", "colour"))
        child = colour.select("kind", F.col("node").alias("child"), "colour")
        parent = colour.select("kind", F.col("node").alias("parent"), F.col("colour").alias("_colour"))
        same = cut_lineage(left.join(child, ["kind", "child"]).join(parent, ["kind", "parent"]).where("colour = _colour").select("kind", "child", "parent", "colour"))
        # back from the node a colour is named after, within the colour
        back = same.select("kind", F.col("parent").alias("child"), F.col("child").alias("parent"))
        mark = colour.select(*KEY, F.when(F.col("node") == F.col("colour"), F.col("colour")).alias("label"))
        ring = _spread_up(mark, back, F.max).where("label IS NOT NULL").withColumnRenamed("label", "ring")
        ring = cut_lineage(ring)
        size = ring.groupBy("kind", "ring").agg(F.count("*").alias("n")).where("n > 1")
        found.append(ring.join(size, ["kind", "ring"], "left_semi").select(*KEY, "ring"))
        gone = ring.select("kind", F.col("node").alias("child"))
        left = cut_lineage(same.join(gone, ["kind", "child"], "left_anti").join(gone.withColumnRenamed("child", "parent"), ["kind", "parent"], "left_anti").select("kind", "child", "parent"))
    none = core.select("kind", F.col("child").alias("node"), F.col("child").alias("ring")).limit(0)
    return reduce(DataFrame.unionByName, found, none)


def on_circles(edges: DataFrame) -> DataFrame:
    """kind, node, ring of every node reached again from itself; ``ring`` is one name per set of nodes on a circle.

    ``edges`` has kind, child, parent; a node may have several parents.  Null ends are no edges; repeated edges count
    once; an empty table gives no rows.
    """
    whole = edges.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).select("kind", "child", "parent").distinct()
    _, spliced, loops, core = contract(whole.withColumn("via", F.array().cast("array<string>")), both_ends=True)
    if not loops:
        return whole.select("kind", F.col("child").alias("node"), F.col("child").alias("ring")).limit(0)
    own = reduce(DataFrame.unionByName, loops).distinct().withColumn("ring", F.col("node"))
    rings = own
    if core is not None:
        found = _components(core)
        rings = found.unionByName(own.join(found, KEY, "left_anti"))
    rings = cut_lineage(rings)
    for log in reversed(spliced):
        if log.isEmpty():
            continue
        # a node spliced out between child and parent is on their circle if they are on one
        a = rings.select("kind", F.col("node").alias("child"), F.col("ring").alias("ring"))
        b = rings.select("kind", F.col("node").alias("parent"), F.col("ring").alias("_ring"))
        got = log.join(a, ["kind", "child"]).join(b, ["kind", "parent"]).where(F.col("ring") == F.col("_ring")).select("kind", "node", "ring")
        rings = cut_lineage(got.unionByName(rings.join(got, KEY, "left_anti")))
    return rings


def _tree_paths(nodes: DataFrame, inside: DataFrame) -> DataFrame:
    """kind, node, path of those ``nodes`` whose way along ``inside`` (at most one parent each) ends at a root."""
    raked, spliced, _, _ = contract(inside.withColumn("via", F.array().cast("array<string>")), both_ends=False)
    tops = nodes.select(*KEY).distinct().join(inside.select("kind", F.col("child").alias("node")), KEY, "left_anti")
    known = tops.select(*KEY, F.array("node").alias("path"))
    for a, b in zip(reversed(raked), reversed(spliced)):
        # in its round a node was raked or spliced below a parent that was contracted later, if at all
        cut = b.select("kind", "node", "parent", "via").unionByName(a.select("kind", F.col("child").alias("node"), "parent", "via"))
        above = known.select("kind", F.col("node").alias("parent"), "path")
        got = salted_join(cut, above, ["kind", "parent"], ["node"]).select("kind", "node", F.concat("path", F.reverse("via"), F.array("node")).alias("path"))
        known = cut_lineage(known.unionByName(got))
    return known


def paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, node, root, depth, path (root first, node last), state of each of ``nodes`` (kind, node).

    ``edges`` gives a node at most one parent; a parent outside ``nodes`` ends the path and is not part of it.  state
    is tree, circle (the node is on a circle) or leads_to_circle; the last two have no root, depth or path.
    """
    link = edges.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).groupBy("kind", "child").agg(F.min("parent").alias("parent"))
    inside = salted_join(link, nodes.select("kind", F.col("node").alias("parent")).distinct(), ["kind", "parent"], ["child"])
    known = _tree_paths(nodes, inside)
    rest = nodes.select(*KEY).distinct().join(known.select(*KEY), KEY, "left_anti")
    rings = on_circles(inside).select(*KEY, F.lit(True).alias("ring"))
    bad = rest.join(rings, KEY, "left").select(*KEY, F.lit(None).cast("string").alias("root"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("path"), F.when(F.col("ring"), "circle").otherwise("leads_to_circle").alias("state"))
    good = known.select(*KEY, F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("depth"), "path", F.lit("tree").alias("state"))
    return good.unionByName(bad)


def _reach(edges: DataFrame) -> DataFrame:
    """kind, low, high, distance (the shortest) of all pairs joined by ``edges`` (kind, low, high, distance), by
    doubling: rounds grow with the logarithm of the depth."""
    reach = cut_lineage(edges.groupBy("kind", "low", "high").agg(F.min("distance").alias("distance")))
    before = None
    while True:
        size = tuple(reach.agg(F.count("*"), F.sum("distance")).first())
        if size == before:
            return reach
        before = size
        mid = reach.select("kind", F.col("low").alias("high"), F.col("high").alias("far"), F.col("distance").alias("more"))
        longer = reach.join(mid, ["kind", "high"]).select("kind", "low", F.col("far").alias("high"), (F.col("distance") + F.col("more")).alias("distance"))
        reach = cut_lineage(reach.unionByName(longer).groupBy("kind", "low", "high").agg(F.min("distance").alias("distance")))


def descendants(edges: DataFrame) -> DataFrame:
    """kind, ancestor, descendant, distance (the shortest) over all links; on a circle a node is its own descendant.

    Nodes with several parents, and those that a circle keeps from having a path, are cut from their parents.  What is
    left are trees: contraction, undone in reverse, gives each node its path, and the nodes on the path are its
    ancestors below the cut.  Only the cut nodes are joined pair by pair; what lies above them is the paths of their
    parents again.  The rows made are those of the result, and as many again for further ways between two nodes.
    """
    every = cut_lineage(edges.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).select("kind", "child", "parent").distinct())
    nodes = cut_lineage(every.select("kind", F.explode(F.array("child", "parent")).alias("node")).distinct())
    several = every.groupBy("kind", F.col("child").alias("node")).agg(F.count("*").alias("n")).where("n > 1").select(*KEY)
    single = every.join(several.select("kind", F.col("node").alias("child")), ["kind", "child"], "left_anti")
    first = _tree_paths(nodes, single)
    # a circle of single parents: all of it and what leads into it is cut as well
    astray = cut_lineage(nodes.join(first.select(*KEY), KEY, "left_anti"))
    cut = cut_lineage(several.unionByName(astray).distinct())
    ways = cut_lineage(first.unionByName(astray.select(*KEY, F.array("node").alias("path"))))
    inner = ways.select("kind", F.col("node").alias("descendant"), F.posexplode("path").alias("at", "ancestor"), (F.size("path") - 1).alias("depth")).select("kind", "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance")).where("distance > 0")
    if cut.isEmpty():
        return inner
    # from a cut node to the top of each of its parents' trees, if that is a cut node too
    links = salted_join(every, cut.select("kind", F.col("node").alias("child")), ["kind", "child"], ["parent"])
    above = cut_lineage(salted_join(links, ways.select("kind", F.col("node").alias("parent"), "path"), ["kind", "parent"], ["child"]))
    tops = above.select("kind", F.col("child").alias("low"), F.element_at("path", 1).alias("high"), F.size("path").alias("distance")).join(cut.select("kind", F.col("node").alias("high")), ["kind", "high"], "left_semi")
    far = _reach(tops.select("kind", "low", "high", "distance"))
    own = cut.select("kind", F.col("node").alias("low"), F.col("node").alias("high"), F.lit(0).alias("distance"))
    # ancestors of a cut node: those on its parents' paths, and the same of each cut node it reaches
    step = above.select("kind", F.col("child").alias("high"), F.posexplode("path").alias("at", "ancestor"), F.size("path").alias("n")).select("kind", "high", "ancestor", (F.col("n") - F.col("at")).alias("more"))
    step = step.groupBy("kind", "high", "ancestor").agg(F.min("more").alias("more"))
    of_cut = cut_lineage(far.unionByName(own).join(step, ["kind", "high"]).select("kind", F.col("low").alias("top"), "ancestor", (F.col("distance") + F.col("more")).alias("distance")).groupBy("kind", "top", "ancestor").agg(F.min("distance").alias("distance")))
    hung = ways.select("kind", F.col("node").alias("descendant"), F.element_at("path", 1).alias("top"), (F.size("path") - 1).alias("depth"))
    outer = hung.join(of_cut, ["kind", "top"]).select("kind", "ancestor", "descendant", (F.col("distance") + F.col("depth")).alias("distance"))
    return inner.unionByName(outer).groupBy("kind", "ancestor", "descendant").agg(F.min("distance").alias("distance"))


def base_name(base: Column) -> Column:
    """A base without blanks around it and without type arguments, however deep; what follows them stays.

    A pass removes the innermost arguments, so as many passes as there are opening brackets are enough.  The end of an
    arrow closes nothing.
    """
    passes = F.sequence(F.lit(0), F.length(F.regexp_replace(base, r"[^\[<]", "")))
    bare = F.aggregate(passes, base, lambda b, _: F.regexp_replace(b, r"\s*(\[[^\[\]]*\]|<(?:[^<>]|(?<==)>)*(?<!=)>)", ""))
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, child, parent, pos of all links whose parent is an entity."""
    ents = table(spark, sf_dir, "code_entities").where(F.col("qualified_name").isNotNull())
    names = ents.select(F.col("qualified_name").alias("parent")).distinct()
    by_parent = ents.where(F.col("parent_class").isNotNull()).select(F.lit("parent_class").alias("kind"), F.col("qualified_name").alias("child"), F.col("parent_class").alias("parent"), F.lit(0).alias("pos")).distinct()
    bases = ents.select(F.lit("base_classes").alias("kind"), F.col("qualified_name").alias("child"), "file_path", F.posexplode("base_classes").alias("pos", "raw")).withColumn("parent", base_name(F.col("raw"))).drop("raw").where(F.length("parent") > 0).distinct()
    direct = salted_join(bases.select("kind", "child", "parent", "pos").unionByName(by_parent), names, ["parent"], ["child"])
    local = ents.where("type = 'class'").groupBy("file_path", F.col("name").alias("parent")).agg(F.min("qualified_name").alias("target"))
    near = bases.where(~F.col("parent").contains(".")).join(names, "parent", "left_anti").join(local, ["file_path", "parent"]).select("kind", "child", F.col("target").alias("parent"), "pos")
    return direct.select("kind", "child", "parent", "pos").unionByName(near)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_circles(entity_links(spark, sf_dir)).select(F.col("node").alias("qualified_name")).distinct()


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth and root of every entity under each kind of link; of several bases the first that is an entity."""
    links = cut_lineage(entity_links(spark, sf_dir))
    first = links.groupBy("kind", "child").agg(F.min_by("parent", F.struct("pos", "parent")).alias("parent"))
    ents = table(spark, sf_dir, "code_entities").where(F.col("qualified_name").isNotNull()).select(F.col("qualified_name").alias("node")).distinct()
    nodes = ents.select(F.explode(F.array(F.lit("parent_class"), F.lit("base_classes"))).alias("kind"), "node")
    return paths(nodes, first).select("kind", F.col("node").alias("qualified_name"), "root", "depth", F.array_join("path", " > ").alias("path"), "state")


def p4_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity with each root its links lead to, over all its bases, and the shortest way there.

    A root has no parent.  An entity without parents is its own root at depth 0; one whose links all run in circles
    has none.
    """
    links = cut_lineage(entity_links(spark, sf_dir).select("kind", "child", "parent").distinct())
    ents = table(spark, sf_dir, "code_entities").where(F.col("qualified_name").isNotNull()).select(F.col("qualified_name").alias("node")).distinct()
    nodes = ents.select(F.explode(F.array(F.lit("parent_class"), F.lit("base_classes"))).alias("kind"), "node")
    roots = nodes.join(links.select("kind", F.col("child").alias("node")), KEY, "left_anti")
    below = salted_join(descendants(links), roots.withColumnRenamed("node", "ancestor"), ["kind", "ancestor"], ["descendant"])
    got = below.select("kind", F.col("descendant").alias("qualified_name"), F.col("ancestor").alias("root"), F.col("distance").alias("depth"))
    return got.unionByName(roots.select("kind", F.col("node").alias("qualified_name"), F.col("node").alias("root"), F.lit(0).alias("depth")))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(entity_links(spark, sf_dir).select("kind", "child", "parent").distinct())


_LINKS = r"""
ents AS (SELECT DISTINCT qualified_name, name, type, file_path, parent_class FROM code_entities WHERE qualified_name IS NOT NULL),
raw AS (SELECT DISTINCT qualified_name AS child, file_path, pos - 1 AS pos, trim(regexp_replace(regexp_replace(regexp_replace(base, '\s*(\[[^\[\]]*\]|<[^<>]*>)', '', 'g'), '\s*(\[[^\[\]]*\]|<[^<>]*>)', '', 'g'), '\s*(\[[^\[\]]*\]|<[^<>]*>)', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS parent
  FROM (SELECT qualified_name, file_path, unnest(base_classes) AS base, generate_subscripts(base_classes, 1) AS pos FROM code_entities)),
links AS (
  SELECT DISTINCT 'parent_class' AS kind, qualified_name AS child, parent_class AS parent, 0 AS pos FROM ents WHERE parent_class IN (SELECT qualified_name FROM ents)
  UNION SELECT 'base_classes', child, parent, pos FROM raw WHERE parent IN (SELECT qualified_name FROM ents)
  UNION SELECT 'base_classes', r.child, min(e.qualified_name), r.pos FROM raw r JOIN ents e ON e.type = 'class' AND e.file_path = r.file_path AND e.name = r.parent
    WHERE strpos(r.parent, '.') = 0 AND r.parent NOT IN (SELECT qualified_name FROM ents) GROUP BY r.child, r.pos, r.parent),
reach AS (SELECT DISTINCT kind, child, parent FROM links UNION SELECT r.kind, r.child, l.parent FROM reach r JOIN links l ON r.kind = l.kind AND r.parent = l.child)
"""

_PATHS = """
first AS (SELECT kind, child, arg_min(parent, (pos, parent)) AS parent FROM links GROUP BY 1, 2),
nodes AS (SELECT DISTINCT kind, qualified_name AS node FROM ents, (VALUES ('parent_class'), ('base_classes')) AS k(kind)),
walk AS (SELECT kind, node, node AS root, 0 AS depth, node AS path FROM nodes WHERE (kind, node) NOT IN (SELECT (kind, child) FROM first)
  UNION ALL SELECT f.kind, f.child, w.root, w.depth + 1, w.path || ' > ' || f.child FROM walk w JOIN first f ON f.kind = w.kind AND f.parent = w.node),
up AS (SELECT DISTINCT kind, child, parent FROM first UNION SELECT u.kind, u.child, f.parent FROM up u JOIN first f ON f.kind = u.kind AND f.child = u.parent)
"""

_FAR = """far AS (SELECT DISTINCT kind, parent AS ancestor, child AS descendant, 1 AS distance FROM links
  UNION SELECT f.kind, f.ancestor, l.child, f.distance + 1 FROM far f JOIN links l ON l.kind = f.kind AND l.parent = f.descendant WHERE f.distance < 64)"""

QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_roots": p4_roots, "p4_descendants": p4_descendants}
SQL = {
    "p4_found": f"WITH RECURSIVE {_LINKS} SELECT DISTINCT child AS qualified_name FROM reach WHERE child = parent",
    "p4_paths": f"""WITH RECURSIVE {_LINKS}, {_PATHS} SELECT n.kind, n.node AS qualified_name, w.root, w.depth, w.path,
  CASE WHEN w.node IS NOT NULL THEN 'tree' WHEN c.child IS NOT NULL THEN 'circle' ELSE 'leads_to_circle' END AS state
  FROM nodes n LEFT JOIN walk w ON w.kind = n.kind AND w.node = n.node LEFT JOIN (SELECT kind, child FROM up WHERE child = parent) c ON c.kind = n.kind AND c.child = n.node""",
    "p4_roots": f"""WITH RECURSIVE {_LINKS}, {_FAR}, n AS (SELECT DISTINCT kind, qualified_name AS node FROM ents, (VALUES ('parent_class'), ('base_classes')) AS k(kind)),
  roots AS (SELECT kind, node FROM n WHERE (kind, node) NOT IN (SELECT (kind, child) FROM links))
  SELECT kind, node AS qualified_name, node AS root, 0 AS depth FROM roots UNION ALL SELECT f.kind, descendant, ancestor, min(distance) FROM far f JOIN roots r ON r.kind = f.kind AND r.node = f.ancestor GROUP BY 1, 2, 3""",
    "p4_descendants": f"""WITH RECURSIVE {_LINKS}, {_FAR} SELECT kind, ancestor, descendant, min(distance) AS distance FROM far GROUP BY 1, 2, 3""",
}
