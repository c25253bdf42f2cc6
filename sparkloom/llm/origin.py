"""Problem 2: generated, minified or vendored source files.

Repository attribute files are parsed and their globs resolved by directory and line.  Where a project declares
nothing, equivalent patterns apply: those such files are widely known to hold (``KNOWN``) and those mined from this
corpus, that is, globs whose files are nearly all declared or shown by their text to be machine-made or third-party.
The evidence of the text is what a program writes at the head of its output, the shape of minified text and bulk data,
and copies: whatever equals a vendored file, but for its head and white space, is vendored too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import cut_lineage, ship, spread, table
from .validity import parse_files

ATTRIBUTE_FILE = ".gitattributes"
#: Attributes that decide, by what they say about a path.
GENERATED, VENDORED = "linguist-generated", "linguist-vendored"
#: What attribute files of public repositories commonly declare, in their own notation; for projects that declare nothing.
KNOWN = """
*.min.js linguist-generated
*.min.css linguist-generated
*.bundle.js linguist-generated
*-bundle.js linguist-generated
*.chunk.js linguist-generated
*.pb.js linguist-generated
*.pb.jsx linguist-generated
*.pb.ts linguist-generated
*.pb.tsx linguist-generated
*_pb.js linguist-generated
*_pb.ts linguist-generated
*_pb.py linguist-generated
*_pb2.py linguist-generated
*_pb2_grpc.py linguist-generated
*.pb.go linguist-generated
*.generated.* linguist-generated
*.g.dart linguist-generated
__generated__/** linguist-generated
node_modules/** linguist-vendored
bower_components/** linguist-vendored
third_party/** linguist-vendored
_vendor/** linguist-vendored
site-packages/** linguist-vendored
/vendor/** linguist-vendored
/external/** linguist-vendored
"""


# -- attribute files -------------------------------------------------------------------------------------------------
def glob_regex(pattern: str) -> str:
    """A regular expression for the path, relative to the attribute file's directory, that ``pattern`` matches.

    A pattern without a slash matches the last part at any depth; one with a slash matches from the directory on, but
    that the directories of ``KNOWN``, written without a leading slash, hold at any depth as ``**/`` would say.
    """
    p = pattern
    anchored = "/" in p.rstrip("/")
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            body = p[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", j + 1
        elif c == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return "^" + ("" if anchored else "(?:.*/)?") + out + "$"


def attribute_rules(text: str) -> list[tuple[int, str, str, str, bool | None]]:
    """(line, path regex, key, attribute, value) of an attribute file; value None: unspecified again by that line.

    ``key`` is a word that every path the pattern matches has among its ``path_keys``.
    """
    rules = []
    for n, line in enumerate(text.splitlines()):
        m = re.match(r'\s*(?:"((?:[^"\\]|\\.)*)"|([^\s#"]\S*))\s+(.*)', line)
        if not m:
            continue
        for word in m.group(3).split():
            name, eq, given = word.lstrip("-!").partition("=")
            if name in (GENERATED, VENDORED):
                value = None if word[0] == "!" else word[0] != "-" and (not eq or given.lower() in ("true", "1", "set"))
                pattern = m.group(1) or m.group(2)
                rules.append((n, glob_regex(pattern), rule_key(pattern), name, value))
    return rules


def rule_key(pattern: str) -> str:
    """The most selective of ``path_keys`` that ``pattern`` fixes: first folder, whole name or extension; ``*`` if none."""
    literal = re.compile(r"[^*?\[\]\\]+").fullmatch
    parts = pattern.strip("/").split("/")
    if "/" in pattern.rstrip("/") and len(parts) > 1 and literal(parts[0]):
        return f"top:{parts[0]}"
    if literal(parts[-1]) and not pattern.endswith("/"):
        return f"name:{parts[-1]}"
    stem, dot, ext = parts[-1].rpartition(".")
    return f"ext:{ext}" if dot and literal(ext) else "*"


def path_keys(path: Column) -> Column:
    """The words a rule may be found by: see ``rule_key``."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.array(
        F.lit("*"),
        F.concat(F.lit("top:"), F.element_at(F.split(path, "/"), 1)),
        F.concat(F.lit("name:"), base),
        F.concat(F.lit("ext:"), F.element_at(F.split(base, r"\."), -1)),
    )


def folders(path: Column) -> Column:
    """The empty string and each folder above ``path``, with its closing slash."""
    parts = F.split(path, "/")
    depth = F.sequence(F.lit(0), F.size(parts) - 1)
    return F.transform(depth, lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))


RULES = "project_name string, dir string, line int, regex string, rule_key string, attribute string, value boolean"


def parsed_rules(attribute_files: DataFrame) -> DataFrame:
    """One row per line and deciding attribute of the attribute files (project_name, relative_path, content)."""
    ship(attribute_files.sparkSession)

    def run(frames):
        import pandas as pd

        names = [c.split()[0] for c in RULES.split(", ")]
        for pdf in frames:
            rows = [(project, path[: -len(ATTRIBUTE_FILE)], *r) for project, path, content in pdf.itertuples(index=False) for r in attribute_rules(content)]
            yield pd.DataFrame(rows, columns=names).astype({"value": "boolean"})

    return attribute_files.where("content IS NOT NULL").select("project_name", "relative_path", "content").mapInPandas(run, RULES)


def declared(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """project_name, relative_path, generated, vendored of ``paths`` as ``rules`` of their own project say it.

    Of the lines that match a path the one in the deepest directory counts, and there the last.  A path meets only the
    rules of the folders above it that share a key with it, and the rows of one project are spread over tasks.
    """
    mine = paths.where("relative_path IS NOT NULL").distinct().join(rules.select("project_name").distinct(), "project_name", "left_semi")
    below = mine.select("*", F.explode(folders(F.col("relative_path"))).alias("dir")).withColumn("rest", F.expr("substring(relative_path, length(dir) + 1)"))
    keyed = below.select("*", F.explode(F.array_distinct(path_keys(F.col("rest")))).alias("rule_key"))
    hit = salted_join(keyed, rules, ["project_name", "dir", "rule_key"], ["relative_path"]).where("rest RLIKE regex")

    def last(attribute: str) -> Column:
        of = F.col("attribute") == attribute
        return F.max_by(F.when(of, F.col("value")), F.when(of, F.struct(F.length("dir"), "line")))

    return hit.groupBy("project_name", "relative_path").agg(last(GENERATED).alias("generated"), last(VENDORED).alias("vendored"))


# -- patterns for projects that declare nothing -----------------------------------------------------------------------
def known(path: Column) -> tuple[Column, Column]:
    """Whether ``KNOWN`` takes a path for generated, for vendored."""
    rx: dict[str, list[str]] = {GENERATED: [], VENDORED: []}
    for line in KNOWN.split("\n"):
        if line:
            pattern, attribute = line.split()
            r = glob_regex(pattern)
            rx[attribute].append(r[1:] if pattern[0] == "/" or "/" not in pattern else "(?:.*/)?" + r[1:])
    return tuple(path.rlike("^(?:" + "|".join(rx[a]) + ")") for a in (GENERATED, VENDORED))


def path_globs(path: Column) -> Column:
    """The globs a path could be declared by: each folder above it, and the ends of its name."""
    parts = F.split(path, "/")
    above = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda d: F.concat(d, F.lit("/**")))
    base = F.element_at(parts, -1)
    ends = F.array(F.regexp_extract(base, r"(\.[^.]+\.[^.]+)$", 1), F.regexp_extract(base, r"([_-][A-Za-z0-9]+\.[^.]+)$", 1))
    return F.array_distinct(F.concat(above, F.transform(F.filter(ends, lambda e: e != ""), lambda e: F.concat(F.lit("*"), e))))


#: A glob is mined if at least so many files of so many projects have it and all but so few of them are known cases.
MINED_FILES, MINED_PROJECTS, MINED_SHARE = 8, 3, 0.95


def mined(files: DataFrame) -> DataFrame:
    """glob, mined_kind, n_files, share: the patterns that hold in ``files`` (project_name, relative_path, kind).

    ``kind`` is null for files not known to be a case.  Counted over all files; globs with one file are gone after the
    map side of the first aggregation.
    """
    each = files.select("project_name", "kind", F.explode(path_globs(F.col("relative_path"))).alias("glob"))
    per_kind = each.groupBy("glob", "project_name", "kind").agg(F.count("*").alias("n"))
    per_glob = per_kind.groupBy("glob", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("n_projects"))
    return (
        per_glob.groupBy("glob")
        .agg(
            F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))).alias("mined_kind"),
            F.sum("n").alias("n_files"),
            (F.coalesce(F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("share"),
            F.max("n_projects").alias("n_projects"),
        )
        .where((F.col("n_files") >= MINED_FILES) & (F.col("n_projects") >= MINED_PROJECTS) & (F.col("share") >= MINED_SHARE))
    )


# -- content ---------------------------------------------------------------------------------------------------------
#: The comments or strings a file opens with, before any code.  Possessive, so that the matcher keeps no place to go
#: back to and its stack does not grow with the number of comment lines.
HEAD = r"^\x{FEFF}?+(?:#![^\n]*+\n)?+(?:\s++|//[^\n]*+|#[^\n]*+|/\*(?:(?!\*/)[\s\S])*+\*/|\"\"\"(?:(?!\"\"\")[\s\S])*+\"\"\"|'''(?:(?!''')[\s\S])*+'''|[\"']use strict[\"'];?+)*+"
#: A comment that ends the file on a line of its own, where some programs put their note.
FOOT = r"(?:^|\n)[ \t]*+((?://|#|/\*)[^\n]*+)$"
#: What programs write about their output, in the languages such notes are written in.
MACHINE = (
    r"(?iU)do not (?:edit|modify)\b|do not (?:edit|modify|change) (?:it|this|by hand|manually)|@generated\b|<auto-?generated|\bauto-?generated\b|\bgenerated (?:code|file|by|from|on|with)\b|\b(?:machine|automatically|auto)[- ](?:written|generated|created|produced)\b"
    r"|manual (?:edits|changes) (?:will|are)|(?:edits|changes) (?:are|will be) (?:lost|overwritten)|\bcreated automatically\b"
    r"|\b(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)|\b(?:generierte|erzeugte)r? (?:datei|code|quelltext)\b|\bnicht (?:von hand|manuell) (?:bearbeiten|ändern)"
    r"|\b(?:archivo|fichero|código|clase) (?:generad|cread)[oa]\b|\b(?:generad|cread)[oa] (?:automáticamente|desde|por|a partir)\b|\bno (?:editar|modificar) (?:a mano|manualmente)"
    r"|\b(?:fichier|code) (?:généré|créé)\b|\b(?:généré|créé)e? (?:automatiquement|depuis|par|à partir)|\bne pas (?:modifier|éditer) (?:à la main|manuellement)"
    r"|\b(?:file|codice) generato\b|\bgenerat[oa] (?:automaticamente|da)\b|\b(?:arquivo|ficheiro|código) gerado\b|\bgerad[oa] (?:automaticamente|por|a partir)\b"
    r"|自动(?:生成|创建)|自動(?:生成|作成)|(?:请勿|不要)(?:手动|直接)?(?:编辑|修改)|сгенерирован\w* (?:автоматически|из)|автоматически сгенерирован"
)
#: The same in words that a person uses of other files.
SPOKEN_OF = r"(?i)\b(?:isn't|is not|not|never|no longer|instead of|unlike|used to be|were|was once|are|reads?|loads?|parses?|calls?|uses?|see|compare|next to|beside|for the|wraps?|elsewhere)\b[^.\n]{0,40}(?:generated|do not edit)|(?:generated|do not edit)[^.\n]{0,40}\b(?:live|lives|elsewhere|files are|code is|stubs|are kept|is kept|belongs?)\b"
#: Heads of third-party files: a name, a version and a licence or right on one line or two, or where it was taken from.
THIRD_PARTY = (
    r"(?im)^[ \t/#*!]*+[\w.@-][\w.@/-]*+ v?\d+\.\d+(?:\.\d+)?\b(?:[^\n]*(?:licen[cs]e|\(c\)|copyright)|[ \t]*\r?\n[ \t/#*!]*+copyright \(c\))|\bupstream: [^\n]*(?:release|version|commit)"
    r"|(?:vendored|copied|taken over|imported) (?:from|verbatim)[^\n]*(?:https?:|v?\d+\.\d+)|local changes are not kept"
)
#: Lines of serialised records, and of accessors as code generators print them.
DATA_LINE = r"(?m)^[ \t]*(?:[\[{(][^\n]*[\])}],?|[-+\d.,\sxXeEa-fA-F]+,?|(?:\"[^\"\n]*\"|'[^'\n]*')(?:[ \t]*:[ \t]*(?:[-+\d.eE]+|\"[^\"\n]*\"|'[^'\n]*'|true|false|null|None|True|False))?,?|[rb]?(?:\"[^\"\n]*\"|'[^'\n]*')[ \t]*\\?)[ \t]*\r?$"
PRINTED_LINE = r"(?m)^[ \t]*(?:[\w$.]+\.prototype\.\w+ = |\$root\.|_?(?:globals\(\)|DESCRIPTOR)\b)[^\n]*$"


#: Bytes written out in a string, as serialised descriptors are.
ESCAPED = r"\\x[0-9a-fA-F]{2}|\\[0-7]{3}"


def chars_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measures(files: DataFrame) -> DataFrame:
    """The files with head, head kinds, shape of the text and fingerprint; JVM expressions over whole contents."""
    c = F.col("content")
    n = F.length(c)
    head = F.regexp_extract(c, HEAD, 0)
    foot = F.regexp_extract(F.substring_index(F.rtrim(c, F.lit(" \t\r\n\f")), "\n", -1), FOOT, 1)
    body = F.substring(c, F.length(head) + 1, n)
    lines = F.greatest(F.size(F.filter(F.split(c, r"\r?\n|\r"), lambda x: F.trim(x) != "")), F.lit(1))
    blank = n - F.length(F.regexp_replace(c, r"\s", ""))
    return files.select(
        "*",
        (F.regexp_replace(head, SPOKEN_OF, "").rlike(MACHINE) | F.regexp_replace(foot, SPOKEN_OF, "").rlike(MACHINE)).alias("machine_head"),
        head.rlike(THIRD_PARTY).alias("third_head"),
        (n / lines).alias("line_length"),
        (blank / n).alias("blank_share"),
        (chars_of(c, DATA_LINE) / n).alias("data_share"),
        F.when(c.contains(".prototype.") | c.contains("$root.") | c.contains("DESCRIPTOR") | c.contains("globals()"), chars_of(c, PRINTED_LINE) / n).otherwise(F.lit(0.0)).alias("printed_share"),
        F.when(c.contains("\\"), chars_of(c, ESCAPED) / n).otherwise(F.lit(0.0)).alias("escaped_share"),
        n.alias("n_chars"),
        F.when(F.length(F.regexp_replace(body, r"\s", "")) >= 120, F.sha2(F.regexp_replace(body, r"\s", ""), 256)).alias("fingerprint"),
    )


#: Cases, of a few hundred bytes each, up to which they are broadcast.
BROADCAST_CASES = 200_000
#: Shape limits: a minified text has few blanks for its long lines; bulk data is nearly all records and not short.
MINIFIED_LINE, MINIFIED_BLANK, DATA_SHARE, DATA_CHARS, PRINTED_SHARE, ESCAPED_SHARE = 110, 0.12, 0.8, 1200, 0.5, 0.1


def judged(marked: DataFrame) -> DataFrame:
    """``marked`` with kind and rule: what a file is by its own declaration, known patterns and text, and why."""
    open_, free = F.col("open"), F.col("has_rules").isNull()
    steps = (
        ("vendored", "declared", F.col("said_vendored")),
        ("generated", "declared", F.col("said_generated")),
        ("vendored", "known pattern", F.col("known_vendored") & free & open_),
        ("vendored", "head", F.col("third_head") & open_),
        ("vendored", "copy", F.coalesce(F.col("copied"), F.lit(False)) & open_),
        ("generated", "known pattern", F.col("known_generated") & free & open_ & ~F.col("minified")),
        ("generated", "head", F.col("machine_head") & open_),
        ("generated", "shape", F.col("printed") & open_),
        ("minified", "known pattern", F.col("known_generated") & free & open_),
        ("minified", "shape", F.col("minified") & open_ & ~F.col("data")),
        ("data", "shape", F.col("data") & open_),
    )
    found = F.lit(None).cast("struct<kind:string,rule:string>")
    for kind, rule, when in reversed(steps):
        found = F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"))).otherwise(found)
    return marked.withColumn("_found", found).select("*", "_found.kind", "_found.rule").drop("_found")


def origin(files: DataFrame) -> DataFrame:
    """path, project_name, relative_path, origin, rule, valid of each file that nobody on the project wrote.

    ``files`` has path, project_name, relative_path, content, indexed_at.  origin is generated, minified, vendored or
    data; rule is what showed it, the first of: declared, mined pattern, known pattern, head, copy, shape.  Null and empty contents
    are no cases; a file scanned several times counts by its last scan; a null project_name is a project of its own.
    ``valid`` is false if the file does not parse (null for unknown languages).  A file that its project's attribute
    file declares hand-written is taken out whatever its looks.  A project whose attribute files say nothing of
    generated or vendored files counts as one without.
    """
    at = F.coalesce(F.col("indexed_at").cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz"))
    named = files.select("path", F.coalesce("project_name", F.lit("")).alias("project_name"), F.coalesce("relative_path", "path").alias("relative_path"), "content", at.alias("indexed_at"))
    full = named.where(F.col("path").isNotNull() & (F.length("content") > 0))
    is_rules = F.col("relative_path").rlike(r"(^|/)\.gitattributes$")
    by_path = known(F.col("relative_path"))
    # what the text shows is worked out in one scan; only the marks go on, never the text
    marks = {
        "project_name": F.col("project_name"), "relative_path": F.col("relative_path"), "text_key": F.xxhash64("content"), "fingerprint": F.col("fingerprint"), "third_head": F.col("third_head"), "machine_head": F.col("machine_head"),
        "known_generated": by_path[0], "known_vendored": by_path[1],
        "minified": (F.col("line_length") >= MINIFIED_LINE) & (F.col("blank_share") <= MINIFIED_BLANK),
        "data": (F.col("data_share") >= DATA_SHARE) & (F.col("n_chars") >= DATA_CHARS),
        "printed": (F.col("printed_share") >= PRINTED_SHARE) | (F.col("escaped_share") >= ESCAPED_SHARE),
    }
    looked = measures(full.where(~is_rules)).select("path", "indexed_at", *[c.alias(k) for k, c in marks.items()])
    one = cut_lineage(looked.groupBy("path").agg(F.max_by(F.struct(*marks), F.struct("indexed_at", "text_key")).alias("m")).select("path", "m.*"))
    if named.where(is_rules).select("path").isEmpty():  # reads the paths alone
        said = one.select("*", *[F.lit(None).cast("boolean").alias(c) for c in ("has_rules", "said_generated", "said_vendored")])
    else:
        rules = cut_lineage(parsed_rules(full.where(is_rules)))
        by_rule = declared(rules, one.select("project_name", "relative_path")).withColumnsRenamed({"generated": "said_generated", "vendored": "said_vendored"})
        has = rules.select("project_name").distinct().withColumn("has_rules", F.lit(True))
        said = salted_join(one, has, ["project_name"], ["path"], "left").join(by_rule, ["project_name", "relative_path"], "left")
    marked = said.withColumn("open", F.coalesce("said_generated", F.lit(True)) & F.coalesce("said_vendored", F.lit(True)))
    # copies: one row per fingerprint, whatever the number of copies
    first = judged(marked.withColumn("copied", F.lit(False)))
    original = first.where("kind = 'vendored' AND fingerprint IS NOT NULL").select("fingerprint").distinct().withColumn("copied", F.lit(True))
    # files without a fingerprint get a key of their own, or all of them would meet in one task
    keyed = marked.withColumn("fingerprint", F.coalesce("fingerprint", F.concat(F.lit("-"), "path")))
    shown = cut_lineage(judged(salted_join(keyed, original, ["fingerprint"], ["path"], "left")).select("path", "project_name", "relative_path", "text_key", "has_rules", "open", "kind", "rule"))
    # patterns mined from all that is known so far, for the projects that declare nothing
    rest = shown.where("has_rules IS NULL AND open").select("path", F.explode(path_globs(F.col("relative_path"))).alias("glob"))
    by_glob = salted_join(rest, mined(shown), ["glob"], ["path"]).groupBy("path").agg(F.max_by("mined_kind", F.struct("share", "n_files", "glob")).alias("mined_kind"))
    kind = F.coalesce("kind", "mined_kind").alias("origin")
    rule = F.when(F.col("mined_kind").isNotNull(), "mined pattern").otherwise(F.col("rule")).alias("rule")
    cases = cut_lineage(shown.join(by_glob, "path", "left").select("path", "project_name", "relative_path", "text_key", kind, rule).where("origin IS NOT NULL"))
    # the texts of the cases: the cases are sent to the scan while they are few, else both sides are shuffled
    few = cases.count() <= BROADCAST_CASES
    texts = files.select("path", "content").where(F.length("content") > 0).withColumn("text_key", F.xxhash64("content"))
    texts = texts.join(F.broadcast(cases) if few else cases, ["path", "text_key"]).dropDuplicates(["path"])
    return parse_files(texts, keep=("project_name", "relative_path", "origin", "rule"))


def p2_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin(spread(table(spark, sf_dir, "parsed_files"), "path")).select("path", "project_name", "relative_path", "origin", "rule", "valid")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_origin(spark, sf_dir).where("valid IS NULL OR valid").select("path").distinct()


QUERIES = {"p2_found": p2_found, "p2_origin": p2_origin}
SQL: dict[str, str] = {}
