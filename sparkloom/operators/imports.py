"""What names in a module stand for, by its imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import IMPORTS, NODES, imports, nodes


def modules(n: DataFrame) -> DataFrame:
    """file_path, module: the shortest prefix under which the file's entities stand."""
    prefix = F.expr("substring(qualified_name, 1, length(qualified_name) - length(name) - 1)")
    return n.groupBy("file_path").agg(F.min_by(prefix, F.struct(F.length(prefix), prefix)).alias("module"))


def resolved_source(module: Column, source: Column, is_package: Column) -> Column:
    """The module a relative import means: leading dots climb from the importing module's package; a script's ./ and
    ../ climb folders.  Other sources stay as they are."""
    parts = F.split(module, r"\.")
    home = F.when(is_package, F.size(parts)).otherwise(F.size(parts) - 1)
    dots = F.length(F.regexp_extract(source, r"^(\.+)", 1))
    steps = F.split(source, "/")
    ups = F.size(F.filter(steps, lambda s: s == ".."))
    climb = lambda k: F.slice(parts, 1, F.greatest(k, F.lit(0)))
    script = F.array_join(F.concat(climb(home - ups), F.filter(steps, lambda s: ~s.isin(".", "..", ""))), ".")
    python = F.array_join(F.concat(climb(home - dots + 1), F.filter(F.split(F.regexp_replace(source, r"^\.+", ""), r"\."), lambda s: s != "")), ".")
    return F.when(source.rlike(r"^\.\.?(/|$)") & source.contains("/"), script).when(source.startswith("."), python).otherwise(source)


def import_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """module, local_name, target, is_wildcard of the imports of every file with entities: what a name in it stands for."""
    f = modules(nodes(spark, sf_dir, "name", "file_path")).select("file_path", F.col("file_path").rlike(r"(^|/)__init__\.py$").alias("is_package"), "module")
    i = imports(spark, sf_dir).where("name IS NOT NULL").join(f, "file_path")
    base = resolved_source(F.col("module"), F.col("source"), F.col("is_package"))
    wild = F.coalesce(F.col("name") == "*", F.lit(False))
    target = F.when(F.col("source").isNull(), F.col("name")).when(wild, base).otherwise(F.concat(base, F.lit("."), F.col("name")))
    return i.select("module", F.coalesce("alias", "name").alias("local_name"), target.alias("target"), wild.alias("is_wildcard")).distinct()


MODULES = "mods AS (SELECT file_path, arg_min(pre, (length(pre), pre)) AS module FROM (SELECT file_path, substring(qualified_name, 1, length(qualified_name) - length(name) - 1) AS pre FROM nodes) GROUP BY 1)"
#: Needs the views nodes and e_imports and MODULES.
IMPORT_MAP = rf"""im0 AS (SELECT m.module, regexp_matches(file_path, '(^|/)__init__\.py$') AS pkg, i.name, alias, source, string_split(m.module, '.') AS p,
    len(string_split(m.module, '.')) - CASE WHEN regexp_matches(file_path, '(^|/)__init__\.py$') THEN 0 ELSE 1 END AS home FROM e_imports i JOIN mods m USING (file_path) WHERE i.name IS NOT NULL),
  im1 AS (SELECT *, CASE WHEN regexp_matches(source, '^\.\.?(/|$)') AND contains(source, '/') THEN array_to_string(list_concat(p[1:greatest(home - len(list_filter(string_split(source, '/'), lambda s: s = '..')), 0)], list_filter(string_split(source, '/'), lambda s: s NOT IN ('.', '..', ''))), '.')
    WHEN starts_with(source, '.') THEN array_to_string(list_concat(p[1:greatest(home - length(regexp_extract(source, '^(\.+)', 1)) + 1, 0)], list_filter(string_split(regexp_replace(source, '^\.+', ''), '.'), lambda s: s <> '')), '.') ELSE source END AS base FROM im0),
  import_map AS (SELECT DISTINCT module, coalesce(alias, name) AS local_name, CASE WHEN source IS NULL THEN name WHEN name = '*' THEN base ELSE base || '.' || name END AS target, name = '*' AS is_wildcard FROM im1)"""

QUERIES = {"import_map": import_map}
SQL = {"import_map": f"WITH {NODES}, {IMPORTS}, {MODULES}, {IMPORT_MAP} SELECT * FROM import_map"}
