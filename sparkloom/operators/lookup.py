"""Lookups and one-hop matches over the graph tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DRIFTED, SETTINGS
from ..session import cut_lineage, table
from .graph import CALLS, EDGES, FILES, IMPORTS, NODES, all_edges, calls, files, imports, nodes
from .skew import SALTS

SHOWN = ["qualified_name", "name", "node_type", "file_path", "start_line"]


def required(text: str) -> str:
    if not text or not text.strip():
        raise ValueError("a name must not be blank")
    return text


# -- lookups ---------------------------------------------------------------------------------------------------------
def find_entity(n: DataFrame, name: str, node_type: str | None = None) -> DataFrame:
    """Nodes whose name or qualified_name is ``name``; both tests reach the scan as a filter."""
    hit = n.where((F.col("name") == required(name)) | (F.col("qualified_name") == name))
    return hit.where(F.col("node_type") == node_type) if node_type else hit


def asked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name that search results mention, looked up by name and by qualified name (two equi-joins)."""
    asked = table(spark, sf_dir, "ranked_results").where("entity_name IS NOT NULL").select(F.col("entity_name").alias("asked")).distinct()
    n = nodes(spark, sf_dir, "name", "file_path", "start_line")
    by_name = n.join(asked, n["name"] == asked["asked"])
    by_qn = n.join(asked, n["qualified_name"] == asked["asked"])
    return by_name.unionByName(by_qn).select("asked", *SHOWN).distinct()


def search_by_name(n: DataFrame, text: str, limit: int = SETTINGS.search_limit) -> DataFrame:
    return n.where(F.col("name").contains(required(text)) | F.col("qualified_name").contains(text)).orderBy("qualified_name").limit(limit)


def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_by_name(nodes(spark, sf_dir, "name", "file_path", "start_line"), "ledger").select(*SHOWN)


def fuzzy(n: DataFrame, text: str, limit: int = SETTINGS.fuzzy_limit) -> DataFrame:
    """Nodes that hold ``text`` in any case, from the exact name down to the mere substring."""
    low, name, qn = required(text).lower(), F.lower("name"), F.lower("qualified_name")
    score = (
        F.when(F.col("name") == text, 0).when(F.col("qualified_name") == text, 1).when((name == low) | (qn == low), 2).when(name.startswith(low), 3).when(name.endswith(low), 4).when(name.contains(low), 5).otherwise(6)
    )
    return n.where(name.contains(low) | qn.contains(low)).withColumn("match_score", score).orderBy("match_score", "name", "qualified_name").limit(limit)


def fuzzy_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy(nodes(spark, sf_dir, "name", "file_path", "start_line"), "session").select(*SHOWN, "match_score")


def file_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir, "name", "file_path", "start_line", "end_line", "signature").where(F.col("node_type").isin("Class", "Function")).select("file_path", "qualified_name", "name", "node_type", "signature", "start_line", "end_line")


def file_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports(spark, sf_dir)


def file_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reverse: files and imports by imported source, counted."""
    return imports(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_imports"), F.count_distinct("file_path").alias("n_files"))


def project_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects with files by path prefix: each file's ancestor folders are exploded, so the prefix join is an
    equi-join."""
    p = table(spark, sf_dir, "projects").select("project_name", F.col("path").alias("root"))
    f = files(spark, sf_dir, "project_name").select("path").withColumn("parts", F.split("path", "/"))
    up = f.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", 1, i), "/"))).alias("root"))
    n = up.groupBy("root").agg(F.count_distinct("path").alias("n_files"))
    return p.join(n, "root", "left").select("project_name", F.coalesce("n_files", F.lit(0)).alias("n_files"))


# -- one hop ---------------------------------------------------------------------------------------------------------
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir, "name", "file_path")
    e = calls(spark, sf_dir)
    return e.join(n, e["src"] == n["qualified_name"]).select(F.col("dst").alias("target"), F.col("name").alias("caller_name"), "qualified_name", "node_type", "file_path")


def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir, "name", "file_path")
    e = calls(spark, sf_dir)
    return e.join(n, e["dst"] == n["qualified_name"]).select(F.col("src").alias("source"), F.col("name").alias("callee_name"), "qualified_name", "node_type", "file_path")


def class_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with their methods; a class without methods has none of them."""
    n = nodes(spark, sf_dir, "name", "parent_class", "file_path")
    m = n.where("node_type = 'Method' AND parent_class IS NOT NULL").groupBy(F.col("parent_class").alias("qualified_name")).agg(F.count("*").alias("n_methods"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("methods"))
    return n.where("node_type = 'Class'").join(m, "qualified_name", "left").select("qualified_name", "file_path", F.coalesce("n_methods", F.lit(0)).alias("n_methods"), F.coalesce("methods", F.lit("")).alias("methods"))


def file_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their numbers of callees, callers, parents and children, each counted before it is joined, so no
    product of the four arises."""
    n = nodes(spark, sf_dir, "name", "file_path", "start_line")
    e = all_edges(spark, sf_dir).where(F.col("edge_type").isin("CALLS", "EXTENDS"))
    out = e.groupBy(F.col("src").alias("qualified_name")).agg(F.count_if(F.col("edge_type") == "CALLS").alias("n_callees"), F.count_if(F.col("edge_type") == "EXTENDS").alias("n_parents"))
    into = e.groupBy(F.col("dst").alias("qualified_name")).agg(F.count_if(F.col("edge_type") == "CALLS").alias("n_callers"), F.count_if(F.col("edge_type") == "EXTENDS").alias("n_children"))
    got = n.join(out, "qualified_name", "left").join(into, "qualified_name", "left").fillna(0, ["n_callees", "n_parents", "n_callers", "n_children"])
    return got.select("file_path", "qualified_name", "node_type", "start_line", "n_callees", "n_callers", "n_parents", "n_children")


def first_names(df: DataFrame, key: str, value: str, out: str, n: int = SETTINGS.related_shown) -> DataFrame:
    """The first ``n`` values of each key in order, as an array, without collecting more than n per task and key."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(value)
    top = df.select(key, value).distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return top.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(out))


def implementation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods with their first callers, callees and siblings of the same file."""
    n = nodes(spark, sf_dir, "file_path").where(F.col("node_type").isin("Function", "Method"))
    e = calls(spark, sf_dir)
    a = first_names(e.select(F.col("dst").alias("qualified_name"), F.col("src").alias("x")), "qualified_name", "x", "callers")
    b = first_names(e.select(F.col("src").alias("qualified_name"), F.col("dst").alias("x")), "qualified_name", "x", "callees")
    s = first_names(n.select("file_path", F.col("qualified_name").alias("x")), "file_path", "x", "in_file", SETTINGS.related_shown + 1)
    got = n.join(a, "qualified_name", "left").join(b, "qualified_name", "left").join(s, "file_path", "left")
    siblings = F.slice(F.filter("in_file", lambda x: x != F.col("qualified_name")), 1, SETTINGS.related_shown)
    return got.select("qualified_name", *[F.coalesce(F.array_join(x, ","), F.lit("")).alias(c) for c, x in (("callers", "callers"), ("callees", "callees"), ("siblings", siblings))])


def usage_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each call, how many other entities the caller uses and the first of them."""
    e = calls(spark, sf_dir)
    used = first_names(e, "src", "dst", "used", SETTINGS.usages_shown + 1).join(e.groupBy("src").agg(F.count("*").alias("n")), "src")
    others = F.array_join(F.slice(F.filter("used", lambda x: x != F.col("dst")), 1, SETTINGS.usages_shown), ",")
    return e.join(used, "src").select(F.col("dst").alias("target"), F.col("src").alias("user"), (F.col("n") - 1).alias("n_others"), others.alias("others"))


#: Characters of the pieces names are joined on.
GRAM = 3


def module_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports with the number of entities that bear the imported name or hold it in their qualified name.

    A name of up to three characters is held by a qualified name that has it among its pieces of that length, which is
    counted per piece and joined once.  Longer names are joined on their rarest piece of three characters with all
    pieces of the qualified names, salted; the test itself follows.  An entity that bears a name without holding it in
    its qualified name is added.
    """
    i = imports(spark, sf_dir).where("name IS NOT NULL AND name <> ''").select("file_path", "name").distinct()
    names = cut_lineage(i.select("name").distinct())
    n = cut_lineage(nodes(spark, sf_dir, "name").select("qualified_name", F.col("name").alias("entity")))

    def pieces(text: str, size: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda k: F.substring(F.col(text), k, size)))

    def of(size: int) -> DataFrame:
        return n.where(F.length("qualified_name") >= size).select("qualified_name", F.explode(pieces("qualified_name", F.lit(size))).alias("gram"))

    counted = reduce(DataFrame.unionByName, [of(k) for k in range(1, GRAM + 1)]).groupBy("gram").agg(F.count("*").alias("n_held"), F.min("qualified_name").alias("first_held"))
    counted = cut_lineage(counted)
    short = names.where(F.length("name") <= GRAM).join(counted, F.col("name") == F.col("gram")).select("name", F.col("n_held").alias("n"), F.col("first_held").alias("first"))
    long = names.where(F.length("name") > GRAM)
    rarest = long.select("name", F.explode(pieces("name", F.lit(GRAM))).alias("gram")).join(counted, "gram").groupBy("name").agg(F.min_by("gram", F.struct("n_held", "gram")).alias("gram"), F.count("*").alias("n_met"))
    asked = rarest.join(long.select("name", F.size(pieces("name", F.lit(GRAM))).alias("n_pieces")), "name").where("n_met = n_pieces").select("name", "gram")
    # the pieces of qualified names have hot values: they are spread by qualified name, the asked names repeated
    grams = of(GRAM).join(asked.select("gram").distinct(), "gram", "left_semi").withColumn("_salt", F.pmod(F.xxhash64("qualified_name"), F.lit(SALTS)))
    salted = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    held = salted.join(grams, ["gram", "_salt"]).where(F.col("qualified_name").contains(F.col("name"))).groupBy("name").agg(F.count("*").alias("n"), F.min("qualified_name").alias("first"))
    apart = n.where(~F.col("qualified_name").contains(F.col("entity"))).groupBy(F.col("entity").alias("name")).agg(F.count("*").alias("n"), F.min("qualified_name").alias("first")).join(names, "name", "left_semi")
    hits = short.unionByName(held).unionByName(apart).groupBy("name").agg(F.sum("n").alias("n_entities"), F.min("first").alias("first_entity"))
    return i.join(hits, "name", "left").select("file_path", "name", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), "first_entity")


# -- documents -------------------------------------------------------------------------------------------------------
CHUNK = ["doc_id", "project_name", "heading_level", "start_line", "end_line", "drift_status", "drift_score"]
LINK = ["document_chunk_id", "code_entity_qualified_name", "code_entity_type", "link_type", "confidence_score", "line_range_start", "line_range_end", "code_version_hash"]


def chunks(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    c = table(spark, sf_dir, "document_chunks")
    wanted = list(cols or CHUNK)
    return c.groupBy("chunk_id").agg(F.max_by(F.struct(*wanted), F.struct(F.coalesce(F.col("created_at").cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz")), F.xxhash64(*wanted))).alias("_v")).select("chunk_id", "_v.*")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_links").select("link_id", *LINK).distinct()


def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the entities they document; links to unknown entities get type 'unknown' and no file."""
    n = nodes(spark, sf_dir, "file_path", "start_line")
    got = links(spark, sf_dir).join(n, F.col("code_entity_qualified_name") == n["qualified_name"], "left")
    return got.select("link_id", "document_chunk_id", "code_entity_qualified_name", "link_type", "confidence_score", F.coalesce("node_type", F.lit("unknown")).alias("entity_type"), F.coalesce("file_path", F.lit("")).alias("entity_file"))


def entity_documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the chunks and documents that describe them."""
    c = chunks(spark, sf_dir, "doc_id", "heading_level", "start_line").withColumnRenamed("start_line", "chunk_line")
    d = table(spark, sf_dir, "documents").select("doc_id", "relative_path", "title")
    l = links(spark, sf_dir)
    return l.join(c, l["document_chunk_id"] == c["chunk_id"]).join(d, "doc_id").select(F.col("code_entity_qualified_name").alias("qualified_name"), "link_id", "chunk_id", "relative_path", "title", "heading_level", "chunk_line", "confidence_score")


def all_drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of drifted chunks with entity and document."""
    c = chunks(spark, sf_dir).where(F.col("drift_status").isin(*DRIFTED)).select("chunk_id", "doc_id", "drift_status", "drift_score")
    l = links(spark, sf_dir).select("link_id", "document_chunk_id", "code_entity_qualified_name")
    n = nodes(spark, sf_dir, "file_path")
    d = table(spark, sf_dir, "documents").select("doc_id", "relative_path")
    return c.join(l, c["chunk_id"] == l["document_chunk_id"]).join(n, l["code_entity_qualified_name"] == n["qualified_name"]).join(d, "doc_id").select("link_id", "chunk_id", "relative_path", "qualified_name", "file_path", "drift_status", "drift_score")


def drifted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("drift_status").isin(*DRIFTED)).select("doc_id", "project_name", "relative_path", "title", "drift_status")


def stale_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose link was made for another version of the file than the one now stored."""
    f = files(spark, sf_dir, "content_hash")
    n = nodes(spark, sf_dir, "file_path")
    l = links(spark, sf_dir).select("link_id", "document_chunk_id", "code_entity_qualified_name", "code_version_hash")
    got = l.join(n, l["code_entity_qualified_name"] == n["qualified_name"]).join(f, n["file_path"] == f["path"])
    return got.where(F.col("code_version_hash") != F.col("content_hash")).select("link_id", "document_chunk_id", "qualified_name", "code_version_hash", "content_hash")


def document_chunks_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document with their place in its order."""
    from pyspark.sql import Window

    c = chunks(spark, sf_dir)
    return c.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_line", "chunk_id"))).select("doc_id", "position", "chunk_id", "heading_level", "start_line", "end_line")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of each entity cut from the stored file by its lines; ok is false where file or lines are missing.

    Only files under their project's root are read.
    """
    n = nodes(spark, sf_dir, "file_path", "start_line", "end_line", "project_name")
    roots = table(spark, sf_dir, "projects").select("project_name", F.col("path").alias("root"))
    f = files(spark, sf_dir, "content").select(F.col("path").alias("file_path"), F.split("content", "\n").alias("lines"))
    got = n.join(roots, "project_name", "left").join(f, "file_path", "left")
    ok = F.expr("lines IS NOT NULL AND start_line >= 1 AND end_line >= start_line AND start_line <= size(lines) AND startswith(file_path, concat(root, '/'))")
    text = F.when(ok, F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
    return got.select("qualified_name", F.coalesce(ok, F.lit(False)).alias("ok"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("snippet_hash"))


def best_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten surest links of each entity, in order; of equal ones the smaller id first."""
    from pyspark.sql import Window

    w = Window.partitionBy("code_entity_qualified_name").orderBy(F.desc("confidence_score"), "link_id")
    return links(spark, sf_dir).withColumn("position", F.row_number().over(w)).where("position <= 10").select("code_entity_qualified_name", "position", "link_id", "link_type", "confidence_score")


_L = "links AS (SELECT DISTINCT link_id, document_chunk_id, code_entity_qualified_name, code_entity_type, link_type, confidence_score, line_range_start, line_range_end, code_version_hash FROM document_links)"
_C = "chunks AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC) AS rn FROM document_chunks) WHERE rn = 1)"
_DRIFT = "('minor_drift', 'major_drift')"

QUERIES = {
    "entity_lookup": asked_entities, "name_search": name_search, "fuzzy_entity": fuzzy_entity, "file_entities": file_entities, "file_dependencies": file_dependencies, "file_dependents": file_dependents, "project_files": project_listing,
    "callers": callers, "callees": callees, "class_with_methods": class_methods, "file_context": file_context, "implementation_context": implementation_context, "usage_patterns": usage_patterns, "module_dependencies": module_dependencies,
    "chunk_links": chunk_links, "entity_documentation": entity_documentation, "all_drifted": all_drifted, "drifted_documents": drifted_documents, "stale_chunks": stale_chunks, "document_chunks": document_chunks_listing, "entity_snippets": snippets, "best_links": best_links,
}
SQL = {
    "entity_lookup": f"WITH {NODES} SELECT DISTINCT asked, qualified_name, name, node_type, file_path, start_line FROM (SELECT DISTINCT entity_name AS asked FROM ranked_results WHERE entity_name IS NOT NULL) JOIN nodes ON name = asked OR qualified_name = asked",
    "name_search": f"WITH {NODES} SELECT qualified_name, name, node_type, file_path, start_line FROM nodes WHERE contains(name, 'ledger') OR contains(qualified_name, 'ledger') ORDER BY qualified_name LIMIT 15",
    "fuzzy_entity": f"""WITH {NODES} SELECT qualified_name, name, node_type, file_path, start_line, CASE WHEN name = 'session' THEN 0 WHEN qualified_name = 'session' THEN 1 WHEN lower(name) = 'session' OR lower(qualified_name) = 'session' THEN 2
      WHEN starts_with(lower(name), 'session') THEN 3 WHEN ends_with(lower(name), 'session') THEN 4 WHEN contains(lower(name), 'session') THEN 5 ELSE 6 END AS match_score
      FROM nodes WHERE contains(lower(name), 'session') OR contains(lower(qualified_name), 'session') ORDER BY match_score, name, qualified_name LIMIT 10""",
    "file_entities": f"WITH {NODES} SELECT file_path, qualified_name, name, node_type, signature, start_line, end_line FROM nodes WHERE node_type IN ('Class', 'Function')",
    "file_dependencies": f"WITH {IMPORTS} SELECT * FROM e_imports",
    "file_dependents": f"WITH {IMPORTS} SELECT source, count(*) AS n_imports, count(DISTINCT file_path) AS n_files FROM e_imports GROUP BY source",
    "project_files": f"WITH {FILES} SELECT p.project_name, count(DISTINCT f.path) AS n_files FROM projects p LEFT JOIN files f ON starts_with(f.path, p.path || '/') GROUP BY p.project_name, p.path",
    "callers": f"WITH {CALLS} SELECT dst AS target, name AS caller_name, qualified_name, node_type, file_path FROM e_calls JOIN nodes ON src = qualified_name",
    "callees": f"WITH {CALLS} SELECT src AS source, name AS callee_name, qualified_name, node_type, file_path FROM e_calls JOIN nodes ON dst = qualified_name",
    "class_with_methods": f"WITH {NODES} SELECT c.qualified_name, c.file_path, count(m.qualified_name) AS n_methods, coalesce(array_to_string(list(m.name ORDER BY m.name), ','), '') AS methods FROM nodes c LEFT JOIN nodes m ON m.node_type = 'Method' AND m.parent_class = c.qualified_name WHERE c.node_type = 'Class' GROUP BY c.qualified_name, c.file_path",
    "file_context": f"""WITH {EDGES} SELECT file_path, qualified_name, node_type, start_line,
      (SELECT count(*) FROM edges e WHERE e.edge_type = 'CALLS' AND e.src = n.qualified_name) AS n_callees, (SELECT count(*) FROM edges e WHERE e.edge_type = 'CALLS' AND e.dst = n.qualified_name) AS n_callers,
      (SELECT count(*) FROM edges e WHERE e.edge_type = 'EXTENDS' AND e.src = n.qualified_name) AS n_parents, (SELECT count(*) FROM edges e WHERE e.edge_type = 'EXTENDS' AND e.dst = n.qualified_name) AS n_children FROM nodes n""",
    "implementation_context": f"""WITH {CALLS}, f AS (SELECT qualified_name, file_path FROM nodes WHERE node_type IN ('Function', 'Method')),
      a AS (SELECT dst AS q, array_to_string(list(src ORDER BY src)[1:10], ',') AS callers FROM e_calls GROUP BY dst), b AS (SELECT src AS q, array_to_string(list(dst ORDER BY dst)[1:10], ',') AS callees FROM e_calls GROUP BY src),
      s AS (SELECT x.qualified_name AS q, array_to_string(list(y.qualified_name ORDER BY y.qualified_name)[1:10], ',') AS siblings FROM f x JOIN f y ON x.file_path = y.file_path AND x.qualified_name <> y.qualified_name GROUP BY x.qualified_name)
      SELECT qualified_name, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees, coalesce(siblings, '') AS siblings FROM f LEFT JOIN a ON a.q = qualified_name LEFT JOIN b ON b.q = qualified_name LEFT JOIN s ON s.q = qualified_name""",
    "usage_patterns": f"""WITH {CALLS} SELECT u.dst AS target, u.src AS user, count(o.dst) AS n_others, coalesce(array_to_string(list(o.dst ORDER BY o.dst) FILTER (WHERE o.dst IS NOT NULL)[1:5], ','), '') AS others
      FROM e_calls u LEFT JOIN e_calls o ON o.src = u.src AND o.dst <> u.dst GROUP BY u.dst, u.src""",
    "module_dependencies": f"""WITH {NODES}, {IMPORTS}, i AS (SELECT DISTINCT file_path, name FROM e_imports WHERE name <> ''),
      h AS (SELECT i.name, count(*) AS n_entities, min(n.qualified_name) AS first_entity FROM (SELECT DISTINCT name FROM i) i JOIN nodes n ON n.name = i.name OR contains(n.qualified_name, i.name) GROUP BY i.name)
      SELECT file_path, i.name, coalesce(n_entities, 0) AS n_entities, first_entity FROM i LEFT JOIN h ON h.name = i.name""",
    "chunk_links": f"WITH {NODES}, {_L} SELECT link_id, document_chunk_id, code_entity_qualified_name, link_type, confidence_score, coalesce(node_type, 'unknown') AS entity_type, coalesce(file_path, '') AS entity_file FROM links LEFT JOIN nodes ON qualified_name = code_entity_qualified_name",
    "entity_documentation": f"WITH {_L}, {_C} SELECT code_entity_qualified_name AS qualified_name, link_id, chunk_id, d.relative_path, d.title, heading_level, c.start_line AS chunk_line, confidence_score FROM links JOIN chunks c ON chunk_id = document_chunk_id JOIN documents d ON d.doc_id = c.doc_id",
    "all_drifted": f"WITH {NODES}, {_L}, {_C} SELECT link_id, chunk_id, d.relative_path, qualified_name, n.file_path, c.drift_status, c.drift_score FROM chunks c JOIN links ON document_chunk_id = chunk_id JOIN nodes n ON qualified_name = code_entity_qualified_name JOIN documents d ON d.doc_id = c.doc_id WHERE c.drift_status IN {_DRIFT}",
    "drifted_documents": f"SELECT doc_id, project_name, relative_path, title, drift_status FROM documents WHERE drift_status IN {_DRIFT}",
    "stale_chunks": f"WITH {NODES}, {FILES}, {_L} SELECT link_id, document_chunk_id, qualified_name, code_version_hash, content_hash FROM links JOIN nodes n ON qualified_name = code_entity_qualified_name JOIN files f ON f.path = n.file_path WHERE code_version_hash <> content_hash",
    "document_chunks": f"WITH {_C} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_line NULLS FIRST, chunk_id) AS position, chunk_id, heading_level, start_line, end_line FROM chunks",
    "entity_snippets": rf"""WITH {NODES}, {FILES}, s AS (SELECT qualified_name, start_line, end_line, n.file_path, p.path AS root, string_split(f.content, chr(10)) AS lines FROM nodes n LEFT JOIN projects p ON p.project_name = n.project_name LEFT JOIN files f ON f.path = n.file_path),
      t AS (SELECT *, coalesce(lines IS NOT NULL AND start_line >= 1 AND end_line >= start_line AND start_line <= len(lines) AND starts_with(file_path, root || '/'), false) AS ok FROM s)
      SELECT qualified_name, ok, sha256(CASE WHEN ok THEN array_to_string(lines[start_line:end_line], chr(10)) ELSE '' END) AS snippet_hash FROM t""",
    "best_links": f"WITH {_L} SELECT code_entity_qualified_name, position, link_id, link_type, confidence_score FROM (SELECT *, row_number() OVER (PARTITION BY code_entity_qualified_name ORDER BY confidence_score DESC, link_id) AS position FROM links) WHERE position <= 10",
}
