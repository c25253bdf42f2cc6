"""Problem 5: functions and methods paired with their documentation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from .syntax.peg import Peg

#: Items of a script file: a documentation comment with the declaration under it, or anything else, taken in large bites.
#: A declaration emits its kind and name; a line that declares nothing is taken as it is.
SCRIPT = r'''
item <- pair / other
pair <- doc:doc gap decl:decl {pair}
decl <- function line / type line / binding line / method line / line
function <- ~"[ \t]*(?:(?:export|default|declare|async)[ \t]+)*function\b[ \t]*\*?[ \t]*" name:ident {function}
type <- ~"[ \t]*(?:(?:export|default|declare|abstract)[ \t]+)*(?:class|interface|enum|namespace|type)[ \t]+" name:ident {type}
binding <- ~"[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+" name:ident annotation? ~"[ \t]*=[ \t]*" value {function}
annotation <- ~"[ \t]*:" (round / square / curly / angle / ~"=>" / ~"[^=\n(){}\[\]<>]")*
value <- ~"(?:async\b[ \t]*)?" (~"function\b" / ~"[A-Za-z_$][\w$]*[ \t]*=>" / angle? ~"[ \t]*" round returned? ~"[ \t]*=>")
returned <- ~"[ \t]*:" (round / square / curly / angle / ~"=>(?=[^\n]*=>)" / ~"[^=\n(){}\[\]<>]")*
method <- ~"[ \t]*(?:(?:public|private|protected|static|readonly|override|abstract|declare|async|get|set)[ \t]+)*\*?[ \t]*" !reserved name:ident ~"[ \t]*[?!]?[ \t]*" angle? ~"[ \t]*\(" {function}
reserved <- ~"(?:if|for|while|switch|return|catch|with|do|new|await|typeof|throw|function|super|import)\b"
ident <- ~"#?[A-Za-z_$\x80-\uffff][\w$]*"
round <- ~"\(" inside* ~"\)"
square <- ~"\[" inside* ~"\]"
curly <- ~"\{" inside* ~"\}"
angle <- ~"<" (angle / round / square / curly / string / ~"=>" / ~"[^<>(){}\[\]'\"`]")* ~">"
inside <- round / square / curly / string / ~"//[^\n]*" / ~"/\*(?:[^*]|\*(?!/))*\*/" / ~"[^(){}\[\]'\"`/]+" / ~"/"
string <- ~"'(?:[^'\\\n]|\\.)*'" / ~"\"(?:[^\"\\\n]|\\.)*\"" / ~"`(?:[^`\\]|\\[\s\S])*`"
doc <- ~"/\*\*(?!/)(?:[^*]|\*(?!/))*\*/"
gap <- ~"[ \t]*\r?\n"
line <- ~"[^\n]*"
other <- code / comment / any
code <- ~"(?>[^/'\"`]+|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\[\s\S])*`|//[^\n]*|/\*(?!\*)(?:[^*]|\*(?!/))*\*/|(?:(?<=[=(,:;!&|?{}\[])|(?<=[=(,:;!&|?{}\[] ))/(?![/*])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/)+"
comment <- ~"/\*(?:[^*]|\*(?!/))*\*/"
any <- ~"[\s\S]"
'''

#: A Python definition up to and with the string that opens its body.
PYTHON = r'''
entity <- space decorator* ~"(?:async[ \t]+)?(?:def|class)[ \t]+" name:name generic? brackets? returns? ~"[ \t]*:" space doc:docstring {docstring}
decorator <- ~"@[ \t]*[\w.]+" brackets? ~"[^\n]*\n" space
name <- ~"\w+"
generic <- ~"[ \t]*" square
brackets <- ~"[ \t]*" round
returns <- ~"[ \t]*->" (round / square / curly / string / ~"[^:(\[{'\"#]")*
round <- ~"\(" inside* ~"\)"
square <- ~"\[" inside* ~"\]"
curly <- ~"\{" inside* ~"\}"
inside <- round / square / curly / string / ~"#[^\n]*" / ~"[^()\[\]{}'\"#]+"
space <- (~"\s+" / ~"#[^\n]*" / ~"\\\n")*
docstring <- ~"[rRuU]?" long
long <- ~"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"" / ~"'{3}(?:[^'\\]|\\[\s\S]|'(?!'{2}))*'{3}" / ~"\"(?:[^\"\\\n]|\\[\s\S])*\"" / ~"'(?:[^'\\\n]|\\[\s\S])*'"
string <- ~"[rRbBuUfF]*" long
'''


def _declared(kind: str):
    return lambda s, caps: (kind, *caps["name"])


@cache
def script_grammar() -> Peg:
    return Peg(SCRIPT, {"pair": lambda s, caps: ("pair", caps["doc"], caps["decl"]), "function": _declared("function"), "type": _declared("type")})


@cache
def python_grammar() -> Peg:
    return Peg(PYTHON, {"docstring": lambda s, caps: (caps["doc"], caps["name"])})


def comment_pairs(content: str) -> list[tuple[int, str, int, int, str | None]]:
    """(line of the declaration, comment, its start, its end, name of the function) of every documentation comment
    directly above a line; the name is None where the line opens no function."""
    out, line, seen, named = [], 1, 0, {}
    for kind, x, y in script_grammar().items(content, "item"):
        if kind != "pair":
            named[x] = content[x:y] if kind == "function" else None
            continue
        (a, b), (c, d) = x, y
        line += content.count("\n", seen, c)
        seen = c
        out.append((line, content[a:b], a, b, next((n for at, n in named.items() if c <= at < d), None)))
        named.clear()
    return out


def python_docstring(code: str) -> tuple[str, int, int, str] | None:
    """(docstring, start, end, name) of the definition that ``code`` begins with; None if its body opens otherwise."""
    out: list = []
    got = python_grammar().rules["entity"](code, 0, {}, {}, out)
    if got is None:
        return None
    (a, b), (c, d) = out[-1]
    return code[a:b], a, b, code[c:d]


# -- does a documentation text say something? -----------------------------------------------------------------------
#: Words that only introduce the entity.  Fixed values.
FILLER = frozenset(
    "a an and are as at be by class code constructor def describe described description desc doc docs docstring document documentation does do for from fn func function functionality get gets handle handles helper here implementation implement "
    "implements in is it its just main method module of on or perform performs routine run runs see self simple simply some summary that the this to todo util utility used use uses using void which with wrapper".split()
)
#: Texts that stand in for documentation, without case, signs and spaces.  Fixed values.
PLACEHOLDERS = frozenset(
    "na none null tbd tba tbc wip todo fixme xxx hack undocumented nodescription nodoc nodocs nodocumentation nodocstring description summary docstring seecode seesource seeabove seebelow selfexplanatory loremipsum loremipsumdolorsitamet writeme "
    "fillme fillmein fillin addme adddescription adddocs adddocstring adddocumentation placeholder missing missingdescription missingdocstring notdocumented documentme descriptiongoeshere yourdescriptionhere insertdescriptionhere typedescriptionhere "
    "descriptionhere shortdescription longdescription extendedsummary tobedone tobedefined tobedocumented comingsoon nocomment".split()
)
NOTE = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|hack|tbd|tba|wip)\b")
_QUOTES = re.compile(r"""^[rRuUbBfF]{0,2}(\"{3}|'{3}|"|')""")
_TAG = re.compile(r"^[@\\](\w+)(.*)$", re.S)
_FIELD = re.compile(r"^:(\w+)([^:]*):(.*)$", re.S)
#: Heads of the sections of a documentation text.  Fixed values.
SECTION = re.compile(r"(?i)^(?:args|arguments|params|parameters|returns?|yields?|raises|throws|exceptions?|examples?|notes?|attributes|keyword args|keyword arguments|other parameters|see also|warnings?|todo)\s*:?\s*$")
_RULE = re.compile(r"^[-=~^*_#.]{2,}$")
_ITEM = re.compile(r"^[*-]*\s*`?\*{0,2}(\w+)`?\s*(?:\(([^)]*)\))?\s*:(?!:)\s*(.*)$", re.S)
#: Tags whose first word is a name, and those that have none.  Fixed values.
NAMED_TAGS = frozenset("param parameter arg argument property prop typeparam template keyword key var ivar cvar raises raise throws exception except type typedef".split())
_WORD = re.compile(r"[^\W\d_]+")


def bare(doc: str) -> list[str]:
    """Lines of a documentation text without comment and quote marks."""
    t = doc.strip()
    m = _QUOTES.match(t)
    if m and len(t) > len(m.group(0)):
        t = t[m.end() :]
    for q in ('"""', "'''"):
        if t.endswith(q):
            t = t[:-3]
    if m and len(m.group(1)) == 1 and t.endswith(m.group(1)):
        t = t[:-1]
    t = re.sub(r"^\s*/\*+", "", t)
    t = re.sub(r"\*+/\s*$", "", t)
    return [re.sub(r"^\s*(?:\*+(?!\w)|///?|#+)?\s*", "", line).rstrip() for line in t.splitlines()]


def stem(word: str) -> str:
    w = word.lower()
    for end in ("ies", "ied"):
        if w.endswith(end) and len(w) > 4:
            return w[:-3] + "y"
    for end in ("ing", "ed", "es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "ls":
        w = w[:-1]
    return w[:-1] if w.endswith("e") and len(w) > 3 else w


def name_parts(name: str) -> set[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])|([A-Z]+)(?=[A-Z][a-z])", lambda m: " ".join(x for x in m.groups() if x) if m.group(1) else m.group(3) + " ", name)
    words = _WORD.findall(spaced.replace("_", " "))
    return {stem(w) for w in words} | {stem("".join(words))}


def said(doc: str | None) -> str:
    """What is left of a documentation text without marks, tags, section heads, names and types of parameters and
    to-do notes."""
    if not doc:
        return ""
    kept, in_section = [], False
    for raw in bare(doc):
        line = re.sub(r"<[^>]*>|\{@\w+\s*([^}]*)\}", r" \1 ", raw).strip() if "<" in raw or "{@" in raw else raw.strip()
        if not line or _RULE.match(line):
            continue
        if SECTION.match(line):
            in_section = True
            continue
        # several tags may stand in one line
        for part in re.split(r"\s+(?=@\w+\s|:(?:param|returns?|rtype|type|raises)\b)", line):
            m = _TAG.match(part)
            f = _FIELD.match(part)
            if m:
                rest = re.sub(r"\{[^}]*\}", " ", m.group(2)).strip()
                if m.group(1).lower() in NAMED_TAGS:
                    rest = re.sub(r"^\[?[\w.$=\]]+\s*[-:]*\s*", "", rest)
                elif m.group(1).lower() in ("type", "rtype", "see", "since", "author", "version", "module", "class", "function", "memberof", "async", "override", "deprecated", "private", "public", "protected", "internal"):
                    rest = "" if len(rest.split()) <= 2 else rest
                part = rest
            elif f:
                part = "" if f.group(1).lower() in ("type", "rtype") else f.group(3).strip()
            elif in_section:
                i = _ITEM.match(part)
                if i:
                    part = i.group(3).strip()
                elif re.fullmatch(r"[\w.\[\], |]+", part) and len(part.split()) == 1:
                    part = ""
            if part and not NOTE.match(part):
                kept.append(part)
    return "\n".join(kept)


def informative(doc: str | None, name: str) -> bool:
    """Whether ``doc`` tells anything beyond the entity's own name, placeholders and the names and types of parameters."""
    text = said(doc)
    if not text:
        return False
    flat = re.sub(r"[\W_]+", "", text.lower())
    if not flat or flat in PLACEHOLDERS:
        return False
    if not flat.isascii() and any(not c.isascii() and c.isalpha() for c in flat) and re.search(r"[぀-ヿ㐀-鿿가-힣]", flat):
        return True
    own = name_parts(name)
    words = [w for w in _WORD.findall(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text).replace("_", " "))]
    if stem("".join(words)) in own:
        return False
    for w in words:
        low = w.lower()
        if low in FILLER or stem(w) in own or low in PLACEHOLDERS:
            continue
        if len(low) > 1:
            return True
    return False


# -- over whole tables ----------------------------------------------------------------------------------------------
def comment_table(files: DataFrame) -> DataFrame:
    """file_path, start_line, comment, doc_start, doc_end, declared from the ``content`` of each script file.

    Null and empty contents give no row; a file scanned several times gives the comments of its last scan.
    """
    scripts = files.where(F.col("path").rlike(r"\.[jt]sx?$") & F.col("content").contains("/**")).groupBy("path").agg(F.max_by("content", F.struct(F.coalesce(F.col("indexed_at").cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz")), F.xxhash64("content"))).alias("content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(path, *r) for path, content in pdf.itertuples(index=False) for r in comment_pairs(content)]
            yield pd.DataFrame(rows, columns=["file_path", "start_line", "comment", "doc_start", "doc_end", "declared"])

    return spread(scripts, "path").mapInPandas(run, "file_path string, start_line int, comment string, doc_start int, doc_end int, declared string")


def pairs(entities: DataFrame, files: DataFrame) -> DataFrame:
    """qualified_name, name, signature, code, doc, doc_source, doc_start, doc_end, declared of functions and methods
    whose documentation says something.

    The documentation is the docstring; if that is null or empty, the string that opens the Python code, or for other
    languages the comment directly above start_line in the file's content.  doc_start and doc_end are the places of
    the documentation as the grammar found it, in the code or, for a comment, in the file; null where it stands in
    neither.  declared is the name of the function that the grammar finds there: another name than the entity's shows
    an entity of an earlier scan than the file.  Entities indexed several times give one
    row, of the last time; a null name counts as empty; rows without qualified_name are left out.
    """
    at = F.coalesce(F.col("indexed_at").cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz"))
    cols = ["name", "file_path", "signature", "docstring", "code", "start_line"]
    wanted = entities.where(F.col("type").isin("function", "method") & F.col("qualified_name").isNotNull())
    latest = wanted.groupBy("qualified_name").agg(F.max_by(F.struct(*cols), F.struct(at, F.xxhash64(*cols))).alias("e")).select("qualified_name", "e.*")
    lacks: Column = F.coalesce(F.col("docstring"), F.lit("")) == ""
    script = F.coalesce(F.col("file_path"), F.lit("")).rlike(r"\.[jt]sx?$")
    comments = comment_table(files).groupBy("file_path", "start_line").agg(F.max_by(F.struct("comment", "doc_start", "doc_end", "declared"), "doc_end").alias("c")).select("file_path", "start_line", "c.*")
    joined = latest.where(lacks & script).join(comments, ["file_path", "start_line"]).select("qualified_name", *cols, "comment", "doc_start", "doc_end", "declared")
    none = {c: F.lit(None).cast(t) for c, t in (("comment", "string"), ("doc_start", "int"), ("doc_end", "int"), ("declared", "string"))}
    ready = latest.where(~(lacks & script)).withColumns(none).unionByName(joined)
    out = "qualified_name string, name string, signature string, code string, doc string, doc_source string, doc_start int, doc_end int, declared string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            fields = ("qualified_name", "name", "file_path", "signature", "docstring", "code", "comment", "doc_start", "doc_end", "declared")
            for q, name, path, sig, doc, code, comment, start, end, declared in zip(*[pdf[c] for c in fields]):
                source, place = "docstring", (None, None)
                got = python_docstring(code) if code and (path or "").endswith(".py") else None
                if got:
                    place, declared = got[1:3], got[3]
                if not doc:
                    if comment is not None:
                        doc, source, place = comment, "comment", (int(start), int(end))
                    else:
                        doc, source = (got[0], "code") if got else (None, "")
                if doc and informative(doc, name or ""):
                    rows.append((q, name, sig, code, "\n".join(bare(doc)).strip(), source, *place, declared))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")]).astype({"doc_start": "Int32", "doc_end": "Int32"})

    return spread(ready, "qualified_name").mapInPandas(run, out)


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "code_entities"), table(spark, sf_dir, "parsed_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pairs(spark, sf_dir).select("qualified_name")


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs}
SQL: dict[str, str] = {}
