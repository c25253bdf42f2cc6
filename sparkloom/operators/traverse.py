"""Bounded traversals with trail semantics, class hierarchies and centrality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..session import cut_lineage, table
from .graph import CALLS, EDGES, EXTENDS, NODES, all_edges, calls, extends, nodes


def trails(edges: DataFrame, hops: int, start: Column | None = None) -> list[DataFrame]:
    """Per depth 1..``hops`` the trails over ``edges`` (src, dst): origin, at, path (nodes), used (edge numbers).

    No edge is used twice in a trail; nodes may recur.  ``start`` filters the first edge, so a lookup of a few nodes
    never touches the rest.  Each level is one equi-join of the frontier with the edges.
    """
    e = edges.select("src", "dst", F.xxhash64("src", "dst").alias("_e"))
    first = e.where(start) if start is not None else e
    level = first.select(F.col("src").alias("origin"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"), F.array("_e").alias("used"))
    out = [level]
    for _ in range(1, hops):
        step = level.join(e, level["at"] == e["src"]).where(~F.array_contains("used", F.col("_e")))
        level = step.select("origin", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("used", F.col("_e")).alias("used"))
        out.append(level)
    return out


def reach(edges: DataFrame, hops: int, start: Column | None = None) -> DataFrame:
    """origin, at, depth, each once: what is reached over trails of 1..``hops`` edges; the origin itself is left out.

    A pair that several trails of different lengths join has a row per depth.  Bounds above the largest depth are cut.
    """
    hops = min(hops, SETTINGS.max_depth)
    per = [t.select("origin", "at", F.lit(d).alias("depth")) for d, t in enumerate(trails(edges, hops, start), 1)]
    return reduce(DataFrame.unionByName, per).where("origin <> at").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def transitive_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach(cut_lineage(calls(spark, sf_dir)), SETTINGS.max_hops).select(F.col("origin").alias("source"), F.col("at").alias("callee"), "depth")


def transitive_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach(cut_lineage(reverse(calls(spark, sf_dir))), SETTINGS.max_hops).select(F.col("origin").alias("target"), F.col("at").alias("caller"), "depth")


def all_paths(edges: DataFrame, pairs: DataFrame, hops: int = SETTINGS.max_path, per_pair: int = SETTINGS.path_results) -> DataFrame:
    """source, target, length, path of the shortest ``per_pair`` trails between each of ``pairs`` (source, target).

    Frontiers keep only nodes from which the target can still be reached in the hops left: the backward reach is
    worked out first, level by level.
    """
    from pyspark.sql import Window

    e = edges.select("src", "dst", F.xxhash64("src", "dst").alias("_e"))
    asked = cut_lineage(pairs.select("source", "target").distinct())
    near = asked.select("target", F.col("target").alias("node"), F.lit(0).alias("left"))
    for d in range(1, hops):
        back = near.where(F.col("left") == d - 1).join(e, F.col("node") == e["dst"]).select("target", F.col("src").alias("node"), F.lit(d).alias("left"))
        near = cut_lineage(near.unionByName(back).groupBy("target", "node").agg(F.min("left").alias("left")))
    level = asked.join(e, asked["source"] == e["src"]).select("source", "target", F.col("dst").alias("at"), F.array("src", "dst").alias("path"), F.array("_e").alias("used"))
    found = []
    for d in range(1, hops + 1):
        found.append(level.where("at = target").select("source", "target", F.lit(d).alias("length"), F.array_join("path", " > ").alias("path")))
        if d == hops:
            break
        can = near.where(F.col("left") <= hops - d).select("target", F.col("node").alias("at"))
        kept = level.join(can, ["target", "at"])
        step = kept.join(e, kept["at"] == e["src"]).where(~F.array_contains("used", F.col("_e")))
        level = cut_lineage(step.select("source", "target", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("used", F.col("_e")).alias("used")))
    got = reduce(DataFrame.unionByName, found)
    w = Window.partitionBy("source", "target").orderBy("length", "path")
    return got.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_pair).drop("n")


def call_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs asked for: the five entities that call most, each with the five called most."""
    e = calls(spark, sf_dir)
    firsts = e.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(5).select(F.col("src").alias("source"))
    lasts = e.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(5).select(F.col("dst").alias("target"))
    numbered = firsts.select("source", F.lit(1).alias("k")).join(lasts.select("target", F.lit(1).alias("k")), "k")  # five by five
    return numbered.where("source <> target").select("source", "target")


def call_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_paths(cut_lineage(calls(spark, sf_dir)), call_pairs(spark, sf_dir))


def shortest_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the shortest chain between the asked pairs."""
    got = all_paths(cut_lineage(calls(spark, sf_dir)), call_pairs(spark, sf_dir), per_pair=1)
    return got.select("source", "target", "length")


def connected_pairs(edges: DataFrame, hops: int = SETTINGS.max_path) -> DataFrame:
    """source, target of every pair that a chain of 1..``hops`` of ``edges`` joins; on a circle a node with itself."""
    last = cut_lineage(edges.select(F.col("src").alias("source"), F.col("dst").alias("target")).distinct())
    pairs = last
    for _ in range(1, hops):
        step = last.join(edges, last["target"] == edges["src"]).select("source", F.col("dst").alias("target")).distinct()
        last = cut_lineage(step.join(pairs, ["source", "target"], "left_anti"))
        if last.isEmpty():
            break
        pairs = pairs.unionByName(last)
    return pairs


def all_call_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``call_paths`` between all pairs of entities that a chain of calls joins."""
    e = cut_lineage(calls(spark, sf_dir))
    return all_paths(e, connected_pairs(e))


def all_shortest_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shortest_chains`` between all pairs of entities that a chain of calls joins."""
    e = cut_lineage(calls(spark, sf_dir))
    return all_paths(e, connected_pairs(e), per_pair=1).select("source", "target", "length")


def class_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors and descendants of every class with depth 1..5."""
    e = cut_lineage(extends(spark, sf_dir).select("src", "dst").distinct())
    up = reach(e, SETTINGS.max_depth).select(F.col("origin").alias("class_name"), F.col("at").alias("related"), "depth", F.lit("ancestor").alias("direction"))
    down = reach(reverse(e), SETTINGS.max_depth).select(F.col("origin").alias("class_name"), F.col("at").alias("related"), "depth", F.lit("descendant").alias("direction"))
    return up.unionByName(down)


def hierarchy_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chain of 0..5 inheritance steps from each class, itself first."""
    e = cut_lineage(extends(spark, sf_dir).select("src", "dst").distinct())
    own = nodes(spark, sf_dir, "name").where("node_type = 'Class'").select(F.col("qualified_name").alias("class_name"), F.lit(0).alias("depth"), F.col("qualified_name").alias("chain"))
    steps = [t.select(F.col("origin").alias("class_name"), F.lit(d).alias("depth"), F.array_join("path", " > ").alias("chain")) for d, t in enumerate(trails(e, SETTINGS.max_depth), 1)]
    return reduce(DataFrame.unionByName, [own, *steps])


def related_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For classes: nodes within two steps of any edge in either direction, with the smallest distance, 20 each.

    Files and imports are nodes like entities.  Of each node in between only its first 21 neighbours are followed: one may be the class itself, and any later one
    has 20 before it, so hubs do not multiply and nothing that belongs to the result is lost.
    """
    from pyspark.sql import Window

    e = all_edges(spark, sf_dir).select("src", "dst").distinct()
    e = e.where("src IS NOT NULL AND dst IS NOT NULL")
    both = cut_lineage(e.unionByName(reverse(e)).distinct())
    starts = nodes(spark, sf_dir, "name").where("node_type = 'Class'").select(F.col("qualified_name").alias("origin"))
    one = starts.join(both, starts["origin"] == both["src"]).select("origin", F.col("dst").alias("at"), F.lit(1).alias("distance"))
    firsts = both.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("n") <= SETTINGS.related_limit + 1).drop("n")
    two = one.withColumnRenamed("at", "mid").join(firsts, F.col("mid") == firsts["src"]).select("origin", F.col("dst").alias("at"), F.lit(2).alias("distance"))
    near = one.unionByName(two).where("origin <> at").groupBy("origin", "at").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("origin").orderBy("distance", "at")
    return near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= SETTINGS.related_limit).select(F.col("origin").alias("class_name"), F.col("at").alias("related"), "distance")


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qualified_name, in_degree, out_degree, total_degree over calls and relationships over all edges.

    One pass: each edge gives a row to either end, so counting needs a single shuffle by node.
    """
    e = all_edges(spark, sf_dir)
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"), "edge_type", "src", "dst").select("x.*", "edge_type", "src", "dst")
    is_call = F.col("edge_type") == "CALLS"
    per = ends.groupBy("node").agg(F.sum(F.when(is_call, F.col("i")).otherwise(0)).alias("in_degree"), F.sum(F.when(is_call, F.col("o")).otherwise(0)).alias("out_degree"), F.sum(F.when((F.col("src") == F.col("dst")) & (F.col("i") == 1), 0).otherwise(1)).alias("relationships"))
    n = nodes(spark, sf_dir, "name").select("qualified_name", "node_type")
    got = n.join(per, n["qualified_name"] == per["node"], "left").fillna(0, ["in_degree", "out_degree", "relationships"])
    return got.select("qualified_name", "node_type", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total_degree"), "relationships")


# -- inheritance -----------------------------------------------------------------------------------------------------
def linearised(e: DataFrame) -> DataFrame:
    """class_name, ancestor, depth, position: breadth-first order of ancestors, the class itself at 0.

    ``e`` has src, dst, pos.  Within a depth ancestors come in the order of the parents they were reached by.  No depth
    is too large: each round joins the ancestors at the largest depth known in full to their own ancestors, which
    doubles that depth, until nothing new is reached.  The first of the shortest ways is made of two such first ways.
    """
    from pyspark.sql import Window

    way = F.lpad(F.col("pos").cast("string"), 4, "0")
    seen = cut_lineage(e.groupBy(F.col("src").alias("class_name"), F.col("dst").alias("ancestor")).agg(F.min(way).alias("way"), F.lit(1).alias("depth")))
    known = 1
    while True:
        further = seen.select(F.col("class_name").alias("mid"), F.col("ancestor").alias("far"), F.col("way").alias("rest"), F.col("depth").alias("more"))
        nxt = seen.where(F.col("depth") == known).join(further, F.col("ancestor") == F.col("mid")).select("class_name", F.col("far").alias("ancestor"), F.struct((F.col("depth") + F.col("more")).alias("depth"), F.concat("way", "rest").alias("way")).alias("v"))
        new = nxt.where("class_name <> ancestor").join(seen.select("class_name", "ancestor"), ["class_name", "ancestor"], "left_anti").groupBy("class_name", "ancestor").agg(F.min("v").alias("v"))
        new = cut_lineage(new.select("class_name", "ancestor", "v.way", "v.depth"))
        if new.isEmpty():
            break
        seen, known = seen.unionByName(new), 2 * known
    w = Window.partitionBy("class_name").orderBy("depth", "way", "ancestor")
    return seen.where("class_name <> ancestor").withColumn("position", F.row_number().over(w)).drop("way")


def mro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linearised(extends(spark, sf_dir))


def inherited_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each class and method name, own or inherited, the first definition along the order of ancestors."""
    n = nodes(spark, sf_dir, "name", "parent_class")
    own = n.where("node_type = 'Method'").select(F.col("parent_class").alias("definer"), "name", F.col("qualified_name").alias("method"))
    order = mro(spark, sf_dir).select("class_name", F.col("ancestor").alias("definer"), "position")
    selves = n.where("node_type = 'Class'").select(F.col("qualified_name").alias("class_name"), F.col("qualified_name").alias("definer"), F.lit(0).alias("position"))
    return order.unionByName(selves).join(own, "definer").groupBy("class_name", "name").agg(F.min_by("method", F.struct("position", "method")).alias("method"))


def subclasses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of direct and of all subclasses of each class; rings are walked once."""
    from .hierarchy import descendants

    e = extends(spark, sf_dir).select("src", "dst").distinct()
    d = descendants(e.select(F.lit("extends").alias("kind"), F.col("src").alias("child"), F.col("dst").alias("parent"))).where("ancestor <> descendant")
    return d.groupBy(F.col("ancestor").alias("class_name")).agg(F.count_if(F.col("distance") == 1).alias("n_direct"), F.count("*").alias("n_all"))


def inheritance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir, "base_classes").where("node_type = 'Class'").select(F.coalesce(F.size("base_classes"), F.lit(0)).alias("k")).select(F.greatest("k", F.lit(0)).alias("k"))
    return n.agg(F.count("*").alias("n_classes"), F.count_if(F.col("k") > 0).alias("n_with_parents"), F.sum("k").alias("n_parents"), F.round(F.avg("k"), 6).alias("avg_parents"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by simple name, how many share it and the nearest by length: the registry of names."""
    n = nodes(spark, sf_dir, "name").select(F.element_at(F.split("qualified_name", r"\."), -1).alias("simple_name"), "qualified_name")
    return n.groupBy("simple_name").agg(F.count("*").alias("n_entities"), F.min_by("qualified_name", F.struct(F.length("qualified_name"), "qualified_name")).alias("nearest"))


def registry_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that search results mention, looked up in the registry by suffix: the entities whose name ends in a dot and
    that name.

    Every entity offers its own suffixes, so the lookup is an equi-join; it is counted per suffix before.
    """
    n = nodes(spark, sf_dir, "name").select("qualified_name")
    asked = table(spark, sf_dir, "ranked_results").where("entity_name <> ''").select(F.col("entity_name").alias("asked")).distinct()
    parts = F.split("qualified_name", r"\.")
    tails = n.where(F.size(parts) > 1).select("qualified_name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))).alias("asked"))
    held = tails.groupBy("asked").agg(F.count("*").alias("n_entities"), F.min_by("qualified_name", F.struct(F.length("qualified_name"), "qualified_name")).alias("nearest"))
    return asked.join(held, "asked").select("asked", "n_entities", "nearest")


def registry_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry by prefix: for every name that stands above some entity, how many entities lie below it."""
    parts = F.split("qualified_name", r"\.")
    n = nodes(spark, sf_dir, "name").where(F.size(parts) > 1).select("node_type", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("prefix"))
    return n.groupBy("prefix").agg(F.count("*").alias("n_entities"), F.count_if(F.col("node_type") == "Class").alias("n_classes"))


def is_subclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the class of a method's caller is a subclass of the class of the method it calls, for every such call."""
    n = nodes(spark, sf_dir, "parent_class").where("node_type = 'Method' AND parent_class IS NOT NULL").select("qualified_name", "parent_class")
    a = n.select(F.col("qualified_name").alias("src"), F.col("parent_class").alias("class_name"))
    b = n.select(F.col("qualified_name").alias("dst"), F.col("parent_class").alias("asked"))
    pairs = calls(spark, sf_dir).join(a, "src").join(b, "dst").select("class_name", "asked").distinct()
    up = linearised(extends(spark, sf_dir)).select("class_name", F.col("ancestor").alias("asked"), F.lit(True).alias("_is"))
    return pairs.join(up, ["class_name", "asked"], "left").select("class_name", "asked", F.coalesce("_is", F.col("class_name") == F.col("asked")).alias("is_subclass"))


def _trail_sql(edges: str, hops: int) -> str:
    return f"""t AS (SELECT src AS origin, dst AS at_node, 1 AS depth, [src || '|' || dst] AS used, src || ' > ' || dst AS path FROM {edges}
  UNION ALL SELECT t.origin, e.dst, t.depth + 1, list_append(t.used, e.src || '|' || e.dst), t.path || ' > ' || e.dst FROM t JOIN {edges} e ON e.src = t.at_node WHERE t.depth < {hops} AND NOT list_contains(t.used, e.src || '|' || e.dst))"""


_REV = "rev AS (SELECT dst AS src, src AS dst FROM e_calls)"
_EXT = "ext AS (SELECT DISTINCT src, dst FROM e_extends)"
_PAIRS = """a AS (SELECT src AS source FROM e_calls GROUP BY src ORDER BY count(*) DESC, src LIMIT 5), b AS (SELECT dst AS target FROM e_calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 5),
  pairs AS (SELECT source, target FROM a, b WHERE source <> target), starts AS (SELECT * FROM e_calls)"""
_PATHS = f"""{_PAIRS}, t AS (SELECT src AS origin, dst AS at_node, 1 AS depth, [src || '|' || dst] AS used, src || ' > ' || dst AS path FROM e_calls WHERE src IN (SELECT source FROM a)
  UNION ALL SELECT t.origin, e.dst, t.depth + 1, list_append(t.used, e.src || '|' || e.dst), t.path || ' > ' || e.dst FROM t JOIN e_calls e ON e.src = t.at_node WHERE t.depth < 4 AND NOT list_contains(t.used, e.src || '|' || e.dst)),
  hits AS (SELECT source, target, depth AS length, path, row_number() OVER (PARTITION BY source, target ORDER BY depth, path) AS n FROM t JOIN pairs ON source = origin AND target = at_node)"""
_MRO = f"""{EXTENDS}, w AS (SELECT src AS class_name, dst AS ancestor, 1 AS depth, lpad(CAST(pos AS VARCHAR), 4, '0') AS way, [src, dst] AS seen FROM e_extends
  UNION ALL SELECT w.class_name, e.dst, w.depth + 1, w.way || lpad(CAST(e.pos AS VARCHAR), 4, '0'), list_append(w.seen, e.dst) FROM w JOIN e_extends e ON e.src = w.ancestor WHERE w.depth < 10 AND NOT list_contains(w.seen, e.dst)),
  m AS (SELECT class_name, ancestor, min(depth) AS depth, arg_min(way, (depth, way)) AS way FROM w WHERE class_name <> ancestor GROUP BY 1, 2),
  mro AS (SELECT class_name, ancestor, depth, row_number() OVER (PARTITION BY class_name ORDER BY depth, way, ancestor) AS position FROM m)"""

QUERIES = {
    "transitive_callees": transitive_callees, "transitive_callers": transitive_callers, "call_paths": call_paths, "shortest_chains": shortest_chains, "all_call_paths": all_call_paths, "all_shortest_chains": all_shortest_chains, "class_hierarchy": class_hierarchy, "hierarchy_chains": hierarchy_chains,
    "related_entities": related_entities, "centrality": degrees, "mro": mro, "inherited_methods": inherited_methods, "subclasses": subclasses, "inheritance_stats": inheritance_stats, "registry": registry, "registry_suffix": registry_suffix, "registry_prefix": registry_prefix, "is_subclass": is_subclass,
}
SQL = {
    "transitive_callees": f"WITH RECURSIVE {CALLS}, {_trail_sql('e_calls', 3)} SELECT DISTINCT origin AS source, at_node AS callee, depth FROM t WHERE origin <> at_node",
    "transitive_callers": f"WITH RECURSIVE {CALLS}, {_REV}, {_trail_sql('rev', 3)} SELECT DISTINCT origin AS target, at_node AS caller, depth FROM t WHERE origin <> at_node",
    "call_paths": f"WITH RECURSIVE {CALLS}, {_PATHS} SELECT source, target, length, path FROM hits WHERE n <= 10",
    "shortest_chains": f"WITH RECURSIVE {CALLS}, {_PATHS} SELECT source, target, length FROM hits WHERE n = 1",
    "all_call_paths": f"WITH RECURSIVE {CALLS}, {_trail_sql('e_calls', 10)}, hits AS (SELECT origin AS source, at_node AS target, depth AS length, path, row_number() OVER (PARTITION BY origin, at_node ORDER BY depth, path) AS n FROM t) SELECT source, target, length, path FROM hits WHERE n <= 10",
    "all_shortest_chains": f"WITH RECURSIVE {CALLS}, {_trail_sql('e_calls', 10)} SELECT origin AS source, at_node AS target, min(depth) AS length FROM t GROUP BY 1, 2",
    "class_hierarchy": f"""WITH RECURSIVE {EXTENDS}, {_EXT}, rext AS (SELECT dst AS src, src AS dst FROM ext), {_trail_sql('ext', 5)}, {_trail_sql('rext', 5).replace('t AS', 'd AS', 1).replace('FROM t JOIN', 'FROM d JOIN').replace('t.', 'd.')}
      SELECT DISTINCT origin AS class_name, at_node AS related, depth, 'ancestor' AS direction FROM t WHERE origin <> at_node UNION ALL SELECT DISTINCT origin, at_node, depth, 'descendant' FROM d WHERE origin <> at_node""",
    "hierarchy_chains": f"WITH RECURSIVE {NODES}, {EXTENDS}, {_EXT}, {_trail_sql('ext', 5)} SELECT qualified_name AS class_name, 0 AS depth, qualified_name AS chain FROM nodes WHERE node_type = 'Class' UNION ALL SELECT origin, depth, path FROM t",
    "related_entities": f"""WITH {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
      one AS (SELECT n.qualified_name AS origin, u.dst AS at_node, 1 AS distance FROM nodes n JOIN u ON u.src = n.qualified_name WHERE n.node_type = 'Class'), two AS (SELECT origin, u.dst AS at_node, 2 AS distance FROM one JOIN u ON u.src = one.at_node),
      near AS (SELECT origin, at_node, min(distance) AS distance FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE origin <> at_node GROUP BY 1, 2)
      SELECT origin AS class_name, at_node AS related, distance FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY distance, at_node) AS n FROM near) WHERE n <= 20""",
    "centrality": f"""WITH {EDGES}, i AS (SELECT dst AS q, count(*) AS n FROM e_calls GROUP BY 1), o AS (SELECT src AS q, count(*) AS n FROM e_calls GROUP BY 1),
      r AS (SELECT q, count(*) AS n FROM (SELECT src AS q, edge_type, src, dst FROM edges UNION SELECT dst, edge_type, src, dst FROM edges) GROUP BY 1)
      SELECT qualified_name, node_type, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) + coalesce(o.n, 0) AS total_degree, coalesce(r.n, 0) AS relationships
      FROM nodes LEFT JOIN i ON i.q = qualified_name LEFT JOIN o ON o.q = qualified_name LEFT JOIN r ON r.q = qualified_name""",
    "mro": f"WITH RECURSIVE {_MRO} SELECT class_name, ancestor, depth, position FROM mro",
    "inherited_methods": f"""WITH RECURSIVE {NODES}, {_MRO}, own AS (SELECT parent_class AS definer, name, qualified_name AS method FROM nodes WHERE node_type = 'Method'),
      o AS (SELECT class_name, ancestor AS definer, position FROM mro UNION ALL SELECT qualified_name, qualified_name, 0 FROM nodes WHERE node_type = 'Class')
      SELECT class_name, name, arg_min(method, (position, method)) AS method FROM o JOIN own USING (definer) GROUP BY 1, 2""",
    "subclasses": f"""WITH RECURSIVE {EXTENDS}, {_EXT}, s AS (SELECT dst AS class_name, src AS sub FROM ext UNION SELECT s.class_name, e.src FROM s JOIN ext e ON e.dst = s.sub)
      SELECT class_name, count(*) FILTER (WHERE (sub, class_name) IN (SELECT (src, dst) FROM ext)) AS n_direct, count(*) AS n_all FROM s WHERE class_name <> sub GROUP BY class_name""",
    "inheritance_stats": f"WITH {NODES} SELECT count(*) AS n_classes, count(*) FILTER (WHERE k > 0) AS n_with_parents, sum(k)::BIGINT AS n_parents, round(avg(k), 6) AS avg_parents FROM (SELECT coalesce(len(base_classes), 0) AS k FROM nodes WHERE node_type = 'Class')",
    "registry": f"WITH {NODES} SELECT string_split(qualified_name, '.')[-1] AS simple_name, count(*) AS n_entities, arg_min(qualified_name, (length(qualified_name), qualified_name)) AS nearest FROM nodes GROUP BY 1",
    "registry_suffix": f"""WITH {NODES}, a AS (SELECT DISTINCT entity_name AS asked FROM ranked_results)
      SELECT asked, count(*) AS n_entities, arg_min(qualified_name, (length(qualified_name), qualified_name)) AS nearest FROM a JOIN nodes ON ends_with(qualified_name, '.' || asked) WHERE asked <> '' GROUP BY 1""",
    "registry_prefix": f"""WITH {NODES}, p AS (SELECT node_type, string_split(qualified_name, '.') AS q FROM nodes), u AS (SELECT node_type, q, unnest(range(1, len(q))) AS k FROM p)
      SELECT array_to_string(q[1:k], '.') AS prefix, count(*) AS n_entities, count(*) FILTER (WHERE node_type = 'Class') AS n_classes FROM u GROUP BY 1""",
    "is_subclass": f"""WITH RECURSIVE {CALLS}, {EXTENDS}, up AS (SELECT DISTINCT src AS class_name, dst AS asked FROM e_extends UNION SELECT u.class_name, e.dst FROM up u JOIN e_extends e ON e.src = u.asked),
      m AS (SELECT qualified_name, parent_class FROM nodes WHERE node_type = 'Method' AND parent_class IS NOT NULL), p AS (SELECT DISTINCT a.parent_class AS class_name, b.parent_class AS asked FROM e_calls JOIN m a ON a.qualified_name = src JOIN m b ON b.qualified_name = dst)
      SELECT class_name, asked, class_name = asked OR (class_name, asked) IN (SELECT (class_name, asked) FROM up) AS is_subclass FROM p""",
}
