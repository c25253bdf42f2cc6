"""Plans of questions: intent, search kind, entities and hops, from rules over the text; salvage of JSON from answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GRAPH_INTENTS, VECTOR_INTENTS
from ..session import table

#: Patterns of entity names in questions.  Fixed values.
CAMEL, SNAKE, BACKTICK = r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", r"\b([a-z]+(?:_[a-z]+)+)\b", r"`([^`]+)`"
#: Intent by phrases in the lower-case question, the first that fits.  Fixed values; some phrases read like patterns but
#: are plain text, as published.
PHRASES = (
    ("find_callers", ("what calls", "who calls", "callers of")),
    ("find_callees", ("calls what", "what does.*call")),
    ("find_call_chain", ("call chain", "eventually call", "path from.*to")),
    ("find_hierarchy", ("extends", "inherits", "subclass", "hierarchy")),
    ("explain_implementation", ("how does", "how is.*implemented", "implementation of")),
    ("locate_entity", ("where is", "find the", "locate")),
    ("find_similar", ("similar to", "like")),
)
FAR = ("eventually", "indirectly", "chain", "path", "through", "via")


def intent_of(question: Column, strict: bool = True) -> Column:
    """The intent by the first phrase that fits; with ``strict=False`` phrases with ``.*`` are patterns."""
    low = F.lower(question)
    out = None
    for intent, phrases in PHRASES:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | (low.contains(p) if strict or ".*" not in p else low.rlike(p))
        out = F.when(hit, intent) if out is None else out.when(hit, intent)
    return out.otherwise("search_functionality")


def search_type(intent: Column) -> Column:
    return F.when(intent.isin(*GRAPH_INTENTS), "graph").when(intent.isin(*VECTOR_INTENTS), "vector").otherwise("hybrid")


def entity_names(question: Column) -> Column:
    """Names in a question: classes, functions, then what stands in backticks."""
    return F.concat(*[F.regexp_extract_all(question, F.lit(p), F.lit(1)) for p in (CAMEL, SNAKE, BACKTICK)])


def plan(questions: DataFrame, text: str = "query_text") -> DataFrame:
    q = F.coalesce(F.col(text), F.lit(""))
    far = F.lit(False)
    for w in FAR:
        far = far | F.lower(q).contains(w)
    intent = intent_of(q)
    return questions.withColumns({"intent": intent, "search_type": search_type(intent), "multi_hop": far, "max_hops": F.when(far, 3).otherwise(1), "entities": entity_names(q)})


def intent_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "search_queries")).select("query_id", "intent", "search_type", "multi_hop", "max_hops")


def plan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(table(spark, sf_dir, "search_queries"))
    return p.select("query_id", F.posexplode("entities").alias("pos", "entity"))


def declared_search_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "search_queries")
    return q.groupBy("primary_intent", search_type(F.col("primary_intent")).alias("search_type")).agg(F.count("*").alias("n"))


# -- JSON in free text -----------------------------------------------------------------------------------------------
def bracketed(text: str) -> str | None:
    """The first balanced object or array of ``text``; brackets in strings do not count."""
    start = next((i for i, c in enumerate(text) if c in "{["), None)
    if start is None:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def salvage(text: str | None, want: type = dict):
    """The JSON value in an answer: bare, fenced, or between other words; None if there is none of the wanted type."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*([\s\S]*?)```", text)
    outer = text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""
    for candidate in (text, fenced and fenced.group(1), outer, bracketed(text)):
        try:
            got = json.loads(candidate) if candidate else None
        except ValueError:
            continue
        if isinstance(got, want):
            return got
    return None


_CASE = " ".join(f"WHEN {' OR '.join(f'contains(q, $${p}$$)' for p in ps)} THEN '{i}'" for i, ps in PHRASES)
_TYPE = f"CASE WHEN intent IN {GRAPH_INTENTS} THEN 'graph' WHEN intent IN {VECTOR_INTENTS} THEN 'vector' ELSE 'hybrid' END"
_FAR = " OR ".join(f"contains(q, '{w}')" for w in FAR)

QUERIES = {"intent_detect": intent_detect, "plan_entities": plan_entities, "search_type": declared_search_types}
SQL = {
    "intent_detect": f"WITH a AS (SELECT query_id, lower(coalesce(query_text, '')) AS q FROM search_queries), b AS (SELECT *, CASE {_CASE} ELSE 'search_functionality' END AS intent FROM a) SELECT query_id, intent, {_TYPE} AS search_type, ({_FAR}) AS multi_hop, CASE WHEN {_FAR} THEN 3 ELSE 1 END AS max_hops FROM b",
    "plan_entities": rf"WITH a AS (SELECT query_id, list_concat(regexp_extract_all(query_text, '{CAMEL}', 1), regexp_extract_all(query_text, '{SNAKE}', 1), regexp_extract_all(query_text, '{BACKTICK}', 1)) AS e FROM search_queries) SELECT query_id, unnest(range(0, len(e)))::INTEGER AS pos, unnest(e) AS entity FROM a",
    "search_type": f"SELECT primary_intent, {_TYPE.replace('intent IN', 'primary_intent IN')} AS search_type, count(*) AS n FROM search_queries GROUP BY 1, 2",
}
