"""References from documents to code: patterns in text and code blocks, matched to entities by full name or its last
parts; and calls resolved to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from .graph import IMPORTS, NODES, extends, nodes
from .imports import IMPORT_MAP, MODULES, import_map, modules
from .lookup import _C, chunks
from .orphans import clean_target
from .skew import salted_join

#: Patterns in lines, and in fenced blocks, with the confidence of a match.  Fixed values.
INLINE = (
    ("backtick_qualified", r"`([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)`", 0.9),
    ("backtick_simple", r"`([A-Za-z_][A-Za-z0-9_]*)`", 0.8),
    ("class_name", r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", 0.6),
    ("function_call", r"\b([a-z_][a-z0-9_]*)\s*\(", 0.5),
)
BLOCK = (
    ("python_def", r"(?:def|async def)\s+([A-Za-z_][A-Za-z0-9_]*)", 0.95),
    ("python_class", r"class\s+([A-Za-z_][A-Za-z0-9_]*)", 0.95),
    ("js_function", r"function\s+([A-Za-z_][A-Za-z0-9_]*)", 0.95),
    ("import_from", r"from\s+[\w.]+\s+import\s+([A-Za-z_][A-Za-z0-9_,\s]*)", 0.85),
)
FENCE = r"```[\s\S]*?```"


def _tagged(column: str, name: str, pattern: str, confidence: float) -> Column:
    return F.transform(F.regexp_extract_all(column, F.lit(pattern), F.lit(1)), lambda t: F.struct(t.alias("text"), F.lit(name).alias("pattern"), F.lit(confidence).alias("confidence")))


def mentions(texts: DataFrame, key: str, content: str) -> DataFrame:
    """``key``, text, pattern, confidence, line of every match; matches in fenced blocks have line 0."""
    lines = texts.select(key, F.posexplode(F.split(content, "\n")).alias("pos", "line"))
    found = F.concat(*[_tagged("line", *x) for x in INLINE])
    inline = lines.select(key, (F.col("pos") + 1).alias("line"), F.explode(found).alias("m")).select(key, "m.*", "line")
    blocks = texts.select(key, F.explode(F.regexp_extract_all(F.col(content), F.lit(FENCE), F.lit(0))).alias("block"))
    inside = F.concat(*[_tagged("block", *x) for x in BLOCK])
    fenced = blocks.select(key, F.explode(inside).alias("m")).select(key, F.explode(F.split("m.text", ",")).alias("text"), "m.pattern", "m.confidence").withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).withColumn("line", F.lit(0))
    return inline.unionByName(fenced.select(key, "text", "pattern", "confidence", "line")).where("text <> ''")


def name_keys(n: DataFrame) -> DataFrame:
    """text, qualified_name, kind: the full name and its last one and two parts, each the smallest name that has it.

    One row per text, so that a name shared by many entities does not multiply what is joined to it.
    """
    parts = F.split("qualified_name", r"\.")
    full = n.select(F.col("qualified_name").alias("text"), "qualified_name", F.lit(0).alias("kind"))
    last = n.select(F.element_at(parts, -1).alias("text"), "qualified_name", F.lit(1).alias("kind"))
    two = n.where(F.size(parts) >= 2).select(F.array_join(F.slice(parts, -2, 2), ".").alias("text"), "qualified_name", F.lit(1).alias("kind"))
    return full.unionByName(last).unionByName(two).groupBy("text").agg(F.min_by("qualified_name", F.struct("kind", "qualified_name")).alias("qualified_name"))


def best_references(found: DataFrame, key: str) -> DataFrame:
    """Per ``key`` and entity the match of highest confidence; of equal ones blocks first, then by line and pattern."""
    order = F.struct((-F.col("confidence")).alias("c"), "line", "pattern", "text")
    return found.groupBy(key, "qualified_name").agg(F.min_by(F.struct("text", "pattern", "confidence", "line"), order).alias("v")).select(key, "qualified_name", "v.*")


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, "content").where("content IS NOT NULL")


def ref_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(chunk_texts(spark, sf_dir), "chunk_id", "content")
    return best_references(m.join(name_keys(nodes(spark, sf_dir, "name").select("qualified_name")), "text"), "chunk_id")


def name_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate names of each chunk, known or not."""
    return mentions(chunk_texts(spark, sf_dir), "chunk_id", "content").select("chunk_id", F.col("text").alias("name")).distinct()


def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between chunks and entities as stored and as found in the text, side by side per chunk."""
    stored = table(spark, sf_dir, "document_links").select(F.col("document_chunk_id").alias("chunk_id"), F.col("code_entity_qualified_name").alias("qualified_name"), "link_type").distinct()
    found = ref_extract(spark, sf_dir).select("chunk_id", "qualified_name", F.lit(1).alias("found"))
    both = stored.join(found, ["chunk_id", "qualified_name"], "full")
    return both.groupBy("chunk_id").agg(F.count_if(F.col("link_type") == "explicit").alias("n_explicit"), F.count_if(F.col("link_type") == "implicit").alias("n_implicit"), F.sum(F.coalesce("found", F.lit(0))).alias("n_found"))


def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level-one heading within the first 20 lines; else null."""
    head = F.slice(F.split("text", "\r?\n"), 1, 20)
    titles = F.filter(F.transform(head, lambda x: F.regexp_extract(x, r"^#\s+(.+)$", 1)), lambda t: t != "")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.get(titles, F.lit(0)).alias("first_heading"))


# -- calls -----------------------------------------------------------------------------------------------------------
#: Built-in names.  Fixed values.
PYTHON_BUILTINS = (
    "print len range int str float bool list dict set tuple open type isinstance hasattr getattr setattr delattr enumerate zip map filter sorted reversed any all sum min max abs round input super classmethod staticmethod property callable iter next "
    "repr hash id dir vars globals locals compile eval exec format Exception ValueError TypeError KeyError IndexError AttributeError RuntimeError StopIteration NotImplementedError AssertionError ImportError OSError IOError FileNotFoundError"
).split()
SCRIPT_BUILTINS = (
    "Object.create Object.keys Object.values Object.entries Object.assign Object.freeze Object.seal Object.defineProperty Object.getOwnPropertyNames Object.getPrototypeOf Array.from Array.isArray Array.of parseInt parseFloat isNaN isFinite encodeURI "
    "decodeURI encodeURIComponent decodeURIComponent console.log console.error console.warn console.info console.debug console.trace JSON.parse JSON.stringify Math.random Math.floor Math.ceil Math.round Math.abs Math.max Math.min Math.pow Math.sqrt "
    "Date.now Date.parse Promise.resolve Promise.reject Promise.all Promise.race Promise.allSettled Reflect.get Reflect.set Reflect.has Reflect.apply setTimeout setInterval clearTimeout clearInterval fetch require"
).split()
SCRIPT_TYPES = "Array Object String Number Date RegExp Function Map Set WeakMap WeakSet Promise Error Boolean Symbol BigInt ArrayBuffer DataView Int8Array Uint8Array Float32Array Float64Array Proxy Reflect Intl".split()


def _prefixes(module: Column) -> Column:
    parts = F.split(module, r"\.")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, 1, k), ".").alias("prefix"), F.size(parts).alias("n")))


def nearest_by_name(asked: DataFrame, n: DataFrame) -> DataFrame:
    """module, simple, nearest: the entity of that simple name with the smallest namespace distance from the module.

    The distance is the number of name parts not shared, less two below the module itself.  Entities are reduced to
    one best per simple name and prefix, and each module looks at its own prefixes only, so no pairs of all callers
    and all bearers of a name arise.
    """
    p = n.select(F.col("name").alias("simple"), "qualified_name", F.split("qualified_name", r"\.").alias("parts"))
    opened = p.select("simple", "qualified_name", F.size("parts").alias("len"), F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda k: F.array_join(F.slice("parts", 1, k), "."))).alias("prefix"))
    best = opened.groupBy("simple", "prefix").agg(F.min(F.struct("len", "qualified_name")).alias("b")).select("simple", "prefix", "b.*")
    levels = asked.select("module", "simple", F.explode(_prefixes(F.col("module"))).alias("x")).select("module", "simple", "x.*")
    d = F.col("n") + F.col("len") - 2 * F.col("k") - F.when(F.col("k") == F.col("n"), 2).otherwise(0)
    return levels.join(best, ["simple", "prefix"]).groupBy("module", "simple").agg(F.min_by("qualified_name", F.struct(d.alias("d"), "qualified_name")).alias("nearest"))


def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, call_name, how, target of every call: the first of full name, super, import, wildcard import, same module, built-in,
    nearest name.

    Calls nothing fits have how 'unresolved' and no target.
    """
    from .traverse import linearised

    # the narrow nodes are written once; every step below reads them from there
    full = cut_lineage(nodes(spark, sf_dir, "name", "file_path", "parent_class", "calls"))
    n = full.drop("calls")
    each = full.select(F.col("qualified_name").alias("caller"), "file_path", "parent_class", F.explode("calls").alias("call_name")).withColumn("call_name", clean_target(F.col("call_name"))).where("call_name <> ''").distinct()
    mods = modules(n)
    each = cut_lineage(each.join(mods, "file_path").select("caller", "module", F.col("file_path").rlike(r"\.[jt]sx?$").alias("script"), F.coalesce("parent_class", F.lit("")).alias("parent_class"), "call_name"))
    # what a call means depends on these alone: hot names of one module are resolved once, not once a caller
    is_super = F.col("call_name").rlike(r"^super(?:\(\))?(?:\.|$)")
    part = lambda k: F.element_at(F.split(F.element_at(F.split("call_name", r"\."), k), r"\("), 1)
    rest = F.regexp_extract("call_name", r"^[^.(]*((?:\.[^(]*)?)", 1)
    wanted = F.when(F.col("call_name").isin("super", "super()"), "__init__").otherwise(F.regexp_extract("call_name", r"^super(?:\(\))?\.([^(]*)", 1))
    key = ["module", "script", "parent_class", "call_name"]
    c = cut_lineage(each.withColumn("parent_class", F.when(is_super, F.col("parent_class")).otherwise("")).select(*key).distinct().select("*", is_super.alias("is_super"), part(-1).alias("simple"), part(1).alias("first"), rest.alias("rest"), F.when(is_super, wanted).alias("wanted")))
    names = n.select(F.col("qualified_name").alias("full"))
    plain = c.where("NOT is_super")
    order = linearised(extends(spark, sf_dir)).select(F.col("class_name").alias("parent_class"), "ancestor", "position")
    own = n.where("node_type = 'Method'").select(F.col("parent_class").alias("ancestor"), F.col("name").alias("wanted"), F.col("qualified_name").alias("method"))
    asked_super = c.where("is_super").select("parent_class", "wanted").distinct()
    supers = asked_super.join(order, "parent_class").join(own, ["ancestor", "wanted"]).groupBy("parent_class", "wanted").agg(F.min_by("method", F.struct("position", "method")).alias("super_target"))
    builtin = F.when(~F.col("script") & F.col("call_name").isin(*PYTHON_BUILTINS), F.concat(F.lit("builtins."), "call_name")).when(F.col("script") & F.col("call_name").isin(*SCRIPT_BUILTINS, *SCRIPT_TYPES), F.concat(F.lit("builtin."), "call_name"))
    # an imported name, or a member of one; a name imported twice means the smallest target that is an entity
    bound = cut_lineage(import_map(spark, sf_dir).select("module", "local_name", "target", "is_wildcard"))
    asked = plain.select("module", "first", "rest").distinct()
    im = bound.where("NOT is_wildcard").select("module", F.col("local_name").alias("first"), "target")
    imported = asked.join(im, ["module", "first"]).select("module", "first", "rest", F.concat("target", "rest").alias("full")).join(names, "full", "left_semi").groupBy("module", "first", "rest").agg(F.min("full").alias("import_hit"))
    # what a module takes over whole from another may be any entity of that one
    star = bound.where("is_wildcard").select("module", "target").distinct()
    starred = asked.join(star, "module").select("module", "first", "rest", F.concat("target", F.lit("."), "first", "rest").alias("full")).join(names, "full", "left_semi").groupBy("module", "first", "rest").agg(F.min("full").alias("star_hit"))
    near = nearest_by_name(plain.select("module", "simple").distinct(), n)
    got = (
        c.join(names.withColumn("full_hit", F.col("full")), c["call_name"] == F.col("full"), "left").drop("full")
        .join(supers, ["parent_class", "wanted"], "left")
        .join(imported, ["module", "first", "rest"], "left")
        .join(starred, ["module", "first", "rest"], "left")
        .withColumn("local", F.concat_ws(".", "module", "first")).join(names.withColumn("local_hit", F.col("full")), F.col("local") == F.col("full"), "left")
        .join(near, ["module", "simple"], "left")
    )
    how = (
        F.when(F.col("full_hit").isNotNull(), "full")
        .when(F.col("super_target").isNotNull(), "super")
        .when(F.col("is_super"), "unresolved")
        .when(F.col("import_hit").isNotNull(), "import")
        .when(F.col("star_hit").isNotNull(), "wildcard")
        .when(F.col("local_hit").isNotNull(), "module")
        .when(builtin.isNotNull(), "builtin")
        .when(F.col("nearest").isNotNull(), "name")
        .otherwise("unresolved")
    )
    target = F.coalesce("full_hit", F.when(F.col("is_super"), F.col("super_target")).otherwise(F.coalesce(F.col("import_hit"), F.col("star_hit"), F.col("local_hit"), builtin, F.col("nearest"))))
    answers = cut_lineage(got.select(*key, how.alias("how"), target.alias("target")))
    back = each.withColumn("parent_class", F.when(is_super, F.col("parent_class")).otherwise(""))
    return salted_join(back, answers, key, ["caller"]).select("caller", "call_name", "how", "target")


def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_calls(spark, sf_dir)


def call_resolution_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_calls(spark, sf_dir).groupBy("how").agg(F.count("*").alias("n_calls"), F.count_distinct("target").alias("n_targets"))


_IN = " UNION ALL ".join(f"SELECT chunk_id, unnest(regexp_extract_all(line, '{p}', 1)) AS text, '{n}' AS pattern, {c}::DOUBLE AS confidence, pos AS line FROM lines" for n, p, c in INLINE)
_BL = " UNION ALL ".join(f"SELECT chunk_id, unnest(string_split(t, ',')) AS text, '{n}' AS pattern, {c}::DOUBLE AS confidence, 0 AS line FROM (SELECT chunk_id, unnest(regexp_extract_all(block, '{p}', 1)) AS t FROM blocks)" for n, p, c in BLOCK)
_MENTIONS = rf"""{_C}, lines AS (SELECT chunk_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM chunks WHERE content IS NOT NULL),
  blocks AS (SELECT chunk_id, unnest(regexp_extract_all(content, '```[\s\S]*?```')) AS block FROM chunks WHERE content IS NOT NULL),
  m AS (SELECT * FROM (SELECT chunk_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, pattern, confidence, line FROM ({_IN} UNION ALL {_BL})) WHERE text <> '')"""
_KEYS = """k0 AS (SELECT qualified_name, string_split(qualified_name, '.') AS p FROM nodes), k1 AS (SELECT qualified_name AS text, qualified_name, 0 AS kind FROM k0 UNION ALL SELECT p[-1], qualified_name, 1 FROM k0 UNION ALL SELECT array_to_string(p[-2:], '.'), qualified_name, 1 FROM k0 WHERE len(p) >= 2),
  keys AS (SELECT text, arg_min(qualified_name, (kind, qualified_name)) AS qualified_name FROM k1 GROUP BY 1)"""
_REF = f"{_MENTIONS}, {_KEYS}, refs AS (SELECT chunk_id, qualified_name, text, pattern, confidence, line FROM (SELECT chunk_id, k.qualified_name, m.*, row_number() OVER (PARTITION BY chunk_id, k.qualified_name ORDER BY confidence DESC, line, pattern, m.text) AS n FROM m JOIN keys k ON k.text = m.text) WHERE n = 1)".replace("SELECT chunk_id, k.qualified_name, m.*", "SELECT m.chunk_id, k.qualified_name, m.text, m.pattern, m.confidence, m.line")
_list = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"

QUERIES = {"ref_extract": ref_extract, "name_extract": name_extract, "link_candidates": link_candidates, "title_extract": title_extract, "call_resolution": call_resolution, "call_resolution_rates": call_resolution_rates}


def _resolution_sql() -> str:
    from .traverse import _MRO

    common = "coalesce(list_position(list_transform(range(1, least(len(mp), len(cp)) + 1), lambda i: mp[i] = cp[i]), false) - 1, least(len(mp), len(cp)))"
    return rf"""WITH RECURSIVE {NODES}, {IMPORTS}, {_MRO},
  {MODULES}, {IMPORT_MAP},
  c AS (SELECT DISTINCT caller, file_path, parent_class, call_name FROM (SELECT qualified_name AS caller, file_path, parent_class, regexp_replace(regexp_replace(regexp_replace(unnest(calls), '^\s+|\s+$', '', 'g'), '\(\)$', ''), '\s+$', '') AS call_name FROM nodes) WHERE call_name <> ''),
  d AS (SELECT c.*, module, string_split(string_split(call_name, '.')[-1], '(')[1] AS simple, string_split(string_split(call_name, '.')[1], '(')[1] AS first, regexp_matches(call_name, '^super(?:\(\))?(?:\.|$)') AS is_super,
    CASE WHEN call_name IN ('super', 'super()') THEN '__init__' ELSE regexp_extract(call_name, '^super(?:\(\))?\.([^(]*)', 1) END AS wanted, regexp_matches(file_path, '\.[jt]sx?$') AS script, regexp_extract(call_name, '^[^.(]*((?:\.[^(]*)?)', 1) AS rest FROM c JOIN mods USING (file_path)),
  imp AS (SELECT d.module, d.first, d.rest, min(n.qualified_name) AS import_hit FROM (SELECT DISTINCT module, first, rest FROM d WHERE NOT is_super) d JOIN import_map i ON i.module = d.module AND i.local_name = d.first AND NOT i.is_wildcard JOIN nodes n ON n.qualified_name = i.target || d.rest GROUP BY 1, 2, 3),
  star AS (SELECT d.module, d.first, d.rest, min(n.qualified_name) AS star_hit FROM (SELECT DISTINCT module, first, rest FROM d WHERE NOT is_super) d JOIN import_map i ON i.module = d.module AND i.is_wildcard JOIN nodes n ON n.qualified_name = i.target || '.' || d.first || d.rest GROUP BY 1, 2, 3),
  sup AS (SELECT m.class_name, n.name, arg_min(n.qualified_name, (position, n.qualified_name)) AS target FROM mro m JOIN nodes n ON n.node_type = 'Method' AND n.parent_class = m.ancestor GROUP BY 1, 2),
  cand AS (SELECT module, simple, qualified_name, string_split(module, '.') AS mp, string_split(qualified_name, '.') AS cp FROM (SELECT DISTINCT module, simple FROM d) JOIN nodes ON name = simple),
  near AS (SELECT module, simple, arg_min(qualified_name, (len(mp) + len(cp) - 2 * {common} - CASE WHEN starts_with(qualified_name, module || '.') THEN 2 ELSE 0 END, qualified_name)) AS nearest FROM cand GROUP BY 1, 2),
  r AS (SELECT d.*, f.qualified_name AS full_hit, s.target AS super_target, l.qualified_name AS local_hit, imp.import_hit, star.star_hit, near.nearest,
    CASE WHEN NOT script AND call_name IN {_list(PYTHON_BUILTINS)} THEN 'builtins.' || call_name WHEN script AND call_name IN {_list([*SCRIPT_BUILTINS, *SCRIPT_TYPES])} THEN 'builtin.' || call_name END AS builtin
    FROM d LEFT JOIN nodes f ON f.qualified_name = call_name LEFT JOIN sup s ON d.is_super AND s.class_name = d.parent_class AND s.name = d.wanted LEFT JOIN nodes l ON l.qualified_name = d.module || '.' || d.first LEFT JOIN imp ON imp.module = d.module AND imp.first = d.first AND imp.rest = d.rest LEFT JOIN star ON star.module = d.module AND star.first = d.first AND star.rest = d.rest LEFT JOIN near ON near.module = d.module AND near.simple = d.simple),
  resolved AS (SELECT caller, call_name, CASE WHEN full_hit IS NOT NULL THEN 'full' WHEN is_super AND super_target IS NOT NULL THEN 'super' WHEN is_super THEN 'unresolved' WHEN import_hit IS NOT NULL THEN 'import' WHEN star_hit IS NOT NULL THEN 'wildcard' WHEN local_hit IS NOT NULL THEN 'module' WHEN builtin IS NOT NULL THEN 'builtin' WHEN nearest IS NOT NULL THEN 'name' ELSE 'unresolved' END AS how,
    CASE WHEN full_hit IS NOT NULL THEN full_hit WHEN is_super THEN super_target ELSE coalesce(import_hit, star_hit, local_hit, builtin, nearest) END AS target FROM r)"""


SQL = {
    "ref_extract": f"WITH {NODES}, {_REF} SELECT * FROM refs",
    "name_extract": f"WITH {_MENTIONS} SELECT DISTINCT chunk_id, text AS name FROM m",
    "link_candidates": f"""WITH {NODES}, {_REF}, s AS (SELECT DISTINCT document_chunk_id AS chunk_id, code_entity_qualified_name AS qualified_name, link_type FROM document_links)
      SELECT chunk_id, count(*) FILTER (WHERE link_type = 'explicit') AS n_explicit, count(*) FILTER (WHERE link_type = 'implicit') AS n_implicit, sum(CASE WHEN found THEN 1 ELSE 0 END)::BIGINT AS n_found
      FROM s FULL JOIN (SELECT chunk_id, qualified_name, true AS found FROM refs) USING (chunk_id, qualified_name) GROUP BY 1""",
    "title_extract": r"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r?\n')[1:20], lambda x: regexp_extract(x, '^#\s+(.+)$', 1)), lambda t: t <> '')[1] AS first_heading FROM documents WHERE text IS NOT NULL",
    "call_resolution": _resolution_sql() + " SELECT caller, call_name, how, target FROM resolved",
    "call_resolution_rates": _resolution_sql() + " SELECT how, count(*) AS n_calls, count(DISTINCT target) AS n_targets FROM resolved GROUP BY 1",
}
