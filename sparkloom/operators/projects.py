"""What can be said of a project without a model: languages, folders, dependencies, entry points, file summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import CALLS, FILES, IMPORTS, NODES, calls, files, imports, nodes


def project_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, lines and share of lines per project and extension."""
    f = files(spark, sf_dir, "project_name", "line_count")
    per = f.groupBy("project_name", F.regexp_extract("path", r"\.(\w+)$", 1).alias("extension")).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("n_lines"))
    whole = per.groupBy("project_name").agg(F.sum("n_lines").alias("all_lines"))
    return per.join(whole, "project_name").select("project_name", "extension", "n_files", "n_lines", F.round(F.when(F.col("all_lines") > 0, F.col("n_lines") / F.col("all_lines")).otherwise(0.0), 6).alias("share"))


def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every folder of every project with its depth and the files at and below it."""
    f = files(spark, sf_dir, "project_name", "relative_path").where("relative_path IS NOT NULL")
    parts = F.split("relative_path", "/")
    up = f.select("project_name", "path", F.size(parts).alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("folder")))).alias("x"))
    return up.groupBy("project_name", F.col("x.folder").alias("folder"), F.col("x.depth").alias("depth")).agg(F.count("*").alias("n_files"), F.count_if(F.col("n") == F.col("x.depth") + 1).alias("n_direct"))


def external_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages from outside that a project imports, and in how many of its files."""
    f = files(spark, sf_dir, "project_name").withColumnRenamed("path", "file_path")
    i = imports(spark, sf_dir).where("is_external").withColumn("package", F.coalesce("source", "name"))
    return i.join(f, "file_path").groupBy("project_name", "package").agg(F.count_distinct("file_path").alias("n_files"))


def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that nobody calls but that call others, and those named main: where a reader might begin."""
    n = nodes(spark, sf_dir, "name", "file_path").where("node_type = 'Function'")
    e = calls(spark, sf_dir)
    out = e.groupBy(F.col("src").alias("qualified_name")).agg(F.count("*").alias("n_calls"))
    into = e.select(F.col("dst").alias("qualified_name")).distinct().withColumn("called", F.lit(True))
    got = n.join(out, "qualified_name", "left").join(into, "qualified_name", "left").fillna(0, ["n_calls"])
    return got.where((F.col("name") == "main") | F.col("called").isNull() & (F.col("n_calls") > 0)).select("qualified_name", "file_path", "n_calls")


def file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with what they define, files without entities too."""
    n = nodes(spark, sf_dir, "file_path").groupBy("file_path").agg(F.count_if(F.col("node_type") == "Class").alias("n_classes"), F.count_if(F.col("node_type") == "Function").alias("n_functions"), F.count_if(F.col("node_type") == "Method").alias("n_methods"))
    return files(spark, sf_dir, "line_count").join(n, F.col("path") == n["file_path"], "left").select("path", "line_count", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_classes", "n_functions", "n_methods")])


def calls_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of unknown receivers by the last part of their name: how many methods bear it, and the first of them.

    Names that begin with an underscore are private and left out.  Bearers are counted per name before the join, so a
    name shared by many methods stays one row.
    """
    n = nodes(spark, sf_dir, "name", "calls")
    bearers = n.where("node_type = 'Method'").groupBy("name").agg(F.count("*").alias("n_methods"), F.min("qualified_name").alias("first_method"))
    asked = n.select(F.col("qualified_name").alias("caller"), F.explode("calls").alias("c")).select("caller", F.regexp_extract(F.trim("c"), r"([^.()]+)(?:\(\))?$", 1).alias("name")).where("name <> '' AND NOT startswith(name, '_')").distinct()
    return asked.join(bearers, "name").select("caller", "name", "n_methods", "first_method")


def name_bearers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The methods behind each name of ``calls_by_name``: a caller is linked to every bearer of its row's name."""
    n = nodes(spark, sf_dir, "name")
    asked = calls_by_name(spark, sf_dir).select("name").distinct()
    return n.where("node_type = 'Method'").join(asked, "name", "left_semi").select("name", F.col("qualified_name").alias("method"))


_LANG = rf"{FILES}, p AS (SELECT project_name, regexp_extract(path, '\.(\w+)$', 1) AS extension, count(*) AS n_files, coalesce(sum(line_count), 0)::BIGINT AS n_lines FROM files GROUP BY 1, 2)"

QUERIES = {
    "project_languages": project_languages, "folder_tree": folder_tree, "external_dependencies": external_dependencies, "entry_points": entry_points, "file_summaries": file_summaries, "calls_by_name": calls_by_name,
    "name_bearers": name_bearers,
}
SQL = {
    "project_languages": f"WITH {_LANG} SELECT project_name, extension, n_files, n_lines, round(CASE WHEN t > 0 THEN n_lines / t ELSE 0 END, 6) AS share FROM p JOIN (SELECT project_name, sum(n_lines)::DOUBLE AS t FROM p GROUP BY 1) USING (project_name)",
    "folder_tree": f"""WITH {FILES}, s AS (SELECT project_name, string_split(relative_path, '/') AS p FROM files WHERE relative_path IS NOT NULL), u AS (SELECT project_name, p, unnest(range(0, len(p)))::INTEGER AS depth FROM s)
      SELECT project_name, array_to_string(p[1:depth], '/') AS folder, depth, count(*) AS n_files, count(*) FILTER (WHERE len(p) = depth + 1) AS n_direct FROM u GROUP BY 1, 2, 3""",
    "external_dependencies": f"WITH {IMPORTS} SELECT f.project_name, coalesce(source, i.name) AS package, count(DISTINCT file_path) AS n_files FROM e_imports i JOIN files f ON f.path = i.file_path WHERE is_external GROUP BY 1, 2",
    "entry_points": f"""WITH {CALLS} SELECT qualified_name, file_path, coalesce(n_calls, 0) AS n_calls FROM nodes LEFT JOIN (SELECT src, count(*) AS n_calls FROM e_calls GROUP BY 1) ON src = qualified_name
      WHERE node_type = 'Function' AND (name = 'main' OR qualified_name NOT IN (SELECT dst FROM e_calls) AND n_calls > 0)""",
    "file_summaries": f"""WITH {NODES}, {FILES} SELECT path, line_count, count(*) FILTER (WHERE node_type = 'Class') AS n_classes, count(*) FILTER (WHERE node_type = 'Function') AS n_functions, count(*) FILTER (WHERE node_type = 'Method') AS n_methods
      FROM files LEFT JOIN nodes ON file_path = path GROUP BY path, line_count""",
    "calls_by_name": rf"""WITH {NODES}, a AS (SELECT DISTINCT caller, regexp_extract(trim(c), '([^.()]+)(?:\(\))?$', 1) AS name FROM (SELECT qualified_name AS caller, unnest(calls) AS c FROM nodes)),
      b AS (SELECT name, count(*) AS n_methods, min(qualified_name) AS first_method FROM nodes WHERE node_type = 'Method' GROUP BY 1) SELECT caller, name, n_methods, first_method FROM a JOIN b USING (name) WHERE name <> '' AND NOT starts_with(name, '_')""",
    "name_bearers": rf"""WITH {NODES}, a AS (SELECT DISTINCT regexp_extract(trim(c), '([^.()]+)(?:\(\))?$', 1) AS name FROM (SELECT unnest(calls) AS c FROM nodes))
      SELECT n.name, n.qualified_name AS method FROM nodes n JOIN a ON a.name = n.name WHERE n.node_type = 'Method' AND a.name <> '' AND NOT starts_with(a.name, '_')""",
}
