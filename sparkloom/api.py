"""One object for what a user of the engine does: index, ask, search, look at documents and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import SETTINGS, Settings
from .errors import QueryError
from .functions.ports import Complete, Embed, complete_column, embed_column, hashing_embedder
from .operators import chunking, graph, lookup, stats, traverse
from .operators.changes import delete_where, difference, swap, upsert
from .operators.vector import cosine
from .plans.planner import plan
from .session import cut_lineage
from .sources.files import module_name, scan, scan_documents
from .sources.parsers import parse_entities, parse_imports


class Engine:
    """The stored tables of ``folder`` and what can be asked of them.  All answers are lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = SETTINGS, embed: Embed | None = None, complete: Complete | None = None):
        self.spark, self.folder, self.settings = spark, folder, settings
        self.embed, self.complete = embed or hashing_embedder(), complete

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._path(name))
        except Exception:  # noqa: BLE001 - not stored yet
            return None

    # -- indexing
    def index(self, root: str, project: str) -> dict[str, int]:
        """Scan ``root``, parse what is new or changed, replace its entities, and forget what is gone."""
        found = scan(self.spark, root).withColumn("project_name", F.lit(project)).withColumn("indexed_at", F.current_timestamp())
        old = self._read("parsed_files")
        if old is not None:
            mine = old.where(F.col("project_name") == project)
            state = cut_lineage(difference(found, mine, "path", "content_hash"))
            todo, gone = state.where("state IN ('new', 'changed')"), state.where("state = 'gone'")
            work = found.join(todo.select("path"), "path", "left_semi")
        else:
            work, gone = found, None
        # written out before any table is swapped: what is read must not change under the plan
        work = cut_lineage(work)
        files = work.join(parse_imports(work).groupBy(F.col("file_path").alias("path")).agg(F.collect_list(F.struct("name", "alias", "source", "is_external", "line_number")).alias("imports")), "path", "left")
        module = work.select(F.col("path").alias("file_path"), module_name(F.col("relative_path"), F.lit(project)).alias("module"), "content")
        e = parse_entities(work).join(module, "file_path")
        lines = F.split("content", "\n")
        entities = e.select(
            F.lit(project).alias("project_name"), "file_path", "type", "name", F.concat_ws(".", "module", "qualified_name").alias("qualified_name"), "signature", "docstring",
            F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("code"), "start_line", "end_line", "is_async", "is_static", "is_classmethod", "decorators",
            F.when(F.col("parent").isNotNull(), F.concat_ws(".", "module", "parent")).alias("parent_class"), "base_classes", "calls", F.array().cast("array<string>").alias("children"), F.current_timestamp().alias("indexed_at"),
        )
        entities = cut_lineage(entities)
        n = {"files": work.count(), "entities": entities.count()}
        self._store("parsed_files", files, old, "path", gone)
        known = self._read("code_entities")
        if known is not None:
            touched = work.select(F.col("path").alias("file_path"))
            if gone is not None:
                touched = touched.unionByName(gone.select(F.col("path").alias("file_path")))
            entities = delete_where(known, touched, ["file_path"]).unionByName(entities)
        swap(entities, self._path("code_entities"))
        self._embed_entities(work.select("path"), gone)
        return n

    def _embed_entities(self, changed: DataFrame, gone: DataFrame | None) -> None:
        """Cut the entities of changed files into chunks and store them with their vectors; other files' stay."""
        touched = changed if gone is None else changed.unionByName(gone.select("path"))
        touched = cut_lineage(touched.select(F.col("path").alias("file_path")).distinct())
        if touched.isEmpty() and self._read("code_chunks") is not None:
            return
        full = self.spark.read.parquet(self._path("code_entities"))
        fresh = full.join(touched, "file_path", "left_semi")
        cut = chunking.chunk_code(fresh.select(F.col("qualified_name").alias("name"), "start_line", chunking.entity_text(fresh).alias("content")), self.settings.chunk_tokens, self.settings.chunk_overlap)
        owner = fresh.select(F.col("qualified_name").alias("name"), "project_name", "file_path", F.col("type").alias("entity_type"))
        vectors = embed_column(cut.join(owner, "name"), "content", port=self.embed)
        new = cut_lineage(vectors.select(F.concat_ws("#", "name", "part").alias("chunk_id"), F.col("name").alias("qualified_name"), "project_name", "file_path", "entity_type", "part", "start_line", "end_line", "content", "content_hash", "embedding"))
        kept = self._read("code_chunks")
        swap(new if kept is None else delete_where(kept, touched, ["file_path"]).unionByName(new), self._path("code_chunks"))

    def _store(self, name: str, new: DataFrame, old: DataFrame | None, key: str, gone: DataFrame | None) -> None:
        table = new if old is None else upsert(old, new.select(*old.columns), [key])
        swap(delete_where(table, gone, [key]) if gone is not None else table, self._path(name))

    def index_documents(self, root: str, project: str) -> int:
        """Scan documents, cut them into sections and store both; unchanged documents are left alone."""
        found = scan_documents(self.spark, root).withColumn("project_name", F.lit(project))
        old = self._read("documents")
        work = found if old is None else found.join(difference(found, old, "path", "content_hash").where("state IN ('new', 'changed')").select("path"), "path", "left_semi")
        docs = work.select("path", "relative_path", "project_name", "content_hash", F.col("content").alias("text"), F.lit("unknown").alias("drift_status"))
        docs = cut_lineage(docs)
        sections = chunking.chunk_documents(docs, "path", "text", self.settings.chunk_tokens, self.settings.chunk_overlap)
        sections = cut_lineage(embed_column(sections.join(docs.select("path", "project_name"), "path"), "content", port=self.embed))
        kept = self._read("document_chunks")
        n = docs.count()
        swap(sections if kept is None else delete_where(kept, docs.select("path"), ["path"]).unionByName(sections), self._path("document_chunks"))
        swap(docs if old is None else upsert(old, docs, ["path"]), self._path("documents"))
        return n

    # -- questions
    def plan(self, question: str) -> dict:
        if not question or not question.strip():
            raise QueryError("a question must not be blank")
        return plan(self.spark.createDataFrame([(question,)], "query_text string")).first().asDict()

    def entity(self, name: str, node_type: str | None = None) -> DataFrame:
        """The entity of that name, else those that resemble it."""
        n = graph.nodes(self.spark, self.folder, "name", "file_path", "start_line")
        exact = lookup.find_entity(n, name, node_type)
        return exact if not exact.isEmpty() else lookup.fuzzy(n, name).drop("match_score")

    def callers(self, name: str, hops: int | None = None) -> DataFrame:
        """Who calls the entity, up to ``hops`` calls away; the start is filtered before the first step."""
        if hops is not None and hops < 1:
            raise QueryError("hops must be at least 1")
        starts = [r[0] for r in self.entity(name).select("qualified_name").limit(self.settings.fuzzy_limit).collect()]
        back = traverse.reverse(graph.calls(self.spark, self.folder))
        got = traverse.reach(back, hops or self.settings.max_hops, F.col("src").isin(starts))
        return got.select(F.col("origin").alias("target"), F.col("at").alias("caller"), "depth").orderBy("depth", "caller").limit(self.settings.total)

    def callees(self, name: str, hops: int | None = None) -> DataFrame:
        starts = [r[0] for r in self.entity(name).select("qualified_name").limit(self.settings.fuzzy_limit).collect()]
        got = traverse.reach(graph.calls(self.spark, self.folder), hops or self.settings.max_hops, F.col("src").isin(starts))
        return got.select(F.col("origin").alias("source"), F.col("at").alias("callee"), "depth").orderBy("depth", "callee").limit(self.settings.total)

    def _scored(self, vectors: DataFrame, text: str) -> DataFrame:
        want = self.embed([text])[0]
        return vectors.withColumn("score", F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in want])), 6)).where("score IS NOT NULL")

    def search(self, text: str, limit: int | None = None, *, entity_type: str | None = None, project: str | None = None, exclude_file: str | None = None) -> DataFrame:
        """Entities whose code is most like ``text``: the best chunk of each counts.

        The vectors are those stored by ``index``; filters come before the score, so they reach the scan.  A store
        without vectors, made elsewhere, gets them on the fly.
        """
        stored = self._read("code_chunks")
        if stored is None:
            n = graph.nodes(self.spark, self.folder, "name", "file_path", "project_name", "type", "code", "signature", "docstring")
            stored = n.select("qualified_name", "file_path", "project_name", F.col("type").alias("entity_type"), chunking.entity_text(n).alias("content"))
        for column, wanted in (("entity_type", entity_type), ("project_name", project)):
            if wanted is not None:
                stored = stored.where(F.col(column) == wanted)
        if exclude_file is not None:
            stored = stored.where(~F.col("file_path").eqNullSafe(exclude_file))
        vectors = stored if "embedding" in stored.columns else embed_column(stored, "content", port=self.embed)
        best = self._scored(vectors, text).groupBy("qualified_name", "file_path", "entity_type").agg(F.max("score").alias("score"))
        kind = F.initcap("entity_type").alias("node_type")
        return best.select("qualified_name", F.element_at(F.split("qualified_name", r"\."), -1).alias("name"), kind, "file_path", "score").orderBy(F.desc("score"), "qualified_name").limit(limit or self.settings.search_limit)

    def search_documents(self, text: str, limit: int | None = None, *, project: str | None = None) -> DataFrame:
        """Sections of documents most like ``text``, from the vectors stored by ``index_documents``."""
        stored = self._read("document_chunks")
        if stored is None or "embedding" not in stored.columns:
            raise QueryError("no documents are indexed")
        if project is not None:
            stored = stored.where(F.col("project_name") == project)
        return self._scored(stored, text).select("path", "seq", "heading_path", "start_line", "end_line", "score").orderBy(F.desc("score"), "path", "seq").limit(limit or self.settings.search_limit)

    def count_vectors(self, part: str) -> int:
        """How many stored chunks have ``part`` in their path."""
        stored = self._read("code_chunks")
        return 0 if stored is None else stored.where(F.col("file_path").contains(part)).count()

    def explain_entity(self, name: str) -> dict:
        """An entity with its callers, callees, class relatives and methods, the first of each."""
        n = self.entity(name).first()
        if n is None:
            raise QueryError(f"no entity {name}")
        q, s = n["qualified_name"], self.settings
        e = graph.calls(self.spark, self.folder)
        methods = graph.nodes(self.spark, self.folder, "parent_class").where(F.col("parent_class") == q)
        parts = {
            "callers": e.where(F.col("dst") == q).select(F.col("src").alias("x")),
            "callees": e.where(F.col("src") == q).select(F.col("dst").alias("x")),
            "methods": methods.select(F.col("qualified_name").alias("x")),
            **{k: df.select(F.col("related").alias("x")) for k, df in self._relatives(q).items()},
        }
        return {**n.asDict(), **{k: [r["x"] for r in df.distinct().orderBy("x").limit(s.related_shown).collect()] for k, df in parts.items()}}

    def _relatives(self, qualified_name: str) -> dict[str, DataFrame]:
        up = graph.extends(self.spark, self.folder).select("src", "dst").distinct()
        start = F.col("src") == qualified_name
        far = self.settings.max_depth
        return {k: traverse.reach(e, far, start).select(F.col("at").alias("related"), "depth") for k, e in (("ancestors", up), ("descendants", traverse.reverse(up)))}

    def find_call_path(self, source: str, target: str, hops: int | None = None) -> DataFrame:
        """The shortest chains of calls between the entities of two names: source, target, length, path."""
        ends = [self.entity(x).select(F.col("qualified_name").alias(c)).limit(self.settings.fuzzy_limit) for x, c in ((source, "source"), (target, "target"))]
        firsts, lasts = ([r[0] for r in df.collect()] for df in ends)  # a few names each
        pairs = self.spark.createDataFrame([(a, b) for a in firsts for b in lasts if a != b], "source string, target string")
        return traverse.all_paths(cut_lineage(graph.calls(self.spark, self.folder)), pairs, min(hops or self.settings.max_path, self.settings.max_path))

    def query(self, question: str, limit: int | None = None) -> DataFrame:
        """Plan a question, gather what the graph and the search know, and rank it: name, how it was found, score."""
        p = self.plan(question)
        parts = []
        for name in p["entities"][:3]:
            own = self.entity(name).select("qualified_name", F.lit("entity").alias("how"), F.lit(1.0).alias("score"))
            parts.append(own)
            if p["intent"] in ("find_callers", "find_call_chain"):
                parts.append(self.callers(name, p["max_hops"]).select(F.col("caller").alias("qualified_name"), F.lit("caller").alias("how"), F.greatest(F.lit(0.3), 1 - (F.col("depth") - 1) * 0.2).alias("score")))
            elif p["intent"] in ("find_callees", "explain_implementation"):
                parts.append(self.callees(name, p["max_hops"]).select(F.col("callee").alias("qualified_name"), F.lit("callee").alias("how"), F.greatest(F.lit(0.3), 1 - (F.col("depth") - 1) * 0.2).alias("score")))
            elif p["intent"] == "find_hierarchy":
                for q in [r[0] for r in own.select("qualified_name").limit(self.settings.fuzzy_limit).collect()]:
                    for how, df in self._relatives(q).items():
                        parts.append(df.select(F.col("related").alias("qualified_name"), F.lit(how[:-1]).alias("how"), F.greatest(F.lit(0.3), 1 - (F.col("depth") - 1) * 0.2).alias("score")))
        if p["intent"] == "find_call_chain" and len(p["entities"]) >= 2:
            chains = self.find_call_path(*p["entities"][:2]).select(F.explode(F.split("path", " > ")).alias("qualified_name"), F.lit("chain").alias("how"), F.lit(1.0).alias("score"))
            parts.append(chains.distinct())
        parts.append(self.search(question).select("qualified_name", F.lit("search").alias("how"), "score"))
        got = parts[0]
        for x in parts[1:]:
            got = got.unionByName(x)
        best = got.groupBy("qualified_name").agg(F.round(F.max("score") + 0.1 * (F.count_distinct("how") - 1), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("how")), ",").alias("how"))
        return best.orderBy(F.desc("score"), "qualified_name").limit(limit or self.settings.search_limit)

    def context(self, question: str, entities: int = 20, snippets: int = 5) -> str:
        """What is known of the entities a question is about, as sections of text for a model: entities with signature
        and documentation, who calls them and whom they call, and the first snippets."""
        s = self.settings
        found = self.query(question, entities)
        n = graph.nodes(self.spark, self.folder, "name", "file_path", "signature", "docstring", "code", "start_line")
        rows = found.join(n, "qualified_name").orderBy(F.desc("score"), "qualified_name").collect()  # at most ``entities``
        names = [r["qualified_name"] for r in rows]
        e = cut_lineage(graph.calls(self.spark, self.folder).where(F.col("src").isin(names) | F.col("dst").isin(names)))
        near: dict[tuple[str, str], list[str]] = {}
        for side, other in (("dst", "src"), ("src", "dst")):
            few = lookup.first_names(e.where(F.col(side).isin(names)), side, other, "shown", s.usages_shown)
            near |= {(r[side], side): r["shown"] for r in few.collect()}
        out = [f"# {question}", "", "## Entities"]
        for r in rows:
            out.append(f"- {r['qualified_name']} ({r['node_type']}) in {r['file_path']}:{r['start_line']}")
            out += [f"  {r['signature']}"] if r["signature"] else []
            out += [f"  {r['docstring'][: s.excerpt_chars]}"] if r["docstring"] else []
            for side, word in (("dst", "called by"), ("src", "calls")):
                if (r["qualified_name"], side) in near:
                    out.append(f"  {word} {', '.join(near[r['qualified_name'], side])}")
        out += ["", "## Code"]
        for r in [r for r in rows if r["code"]][:snippets]:
            code = r["code"] if len(r["code"]) <= s.drift_doc_chars else r["code"][: s.drift_doc_chars] + "\n... (truncated)"
            out += [f"### {r['qualified_name']}", "```", code, "```"]
        return "\n".join(out)

    def answer(self, question: str) -> str | None:
        """The answer of the plugged-in model over the question's context; without one an extract."""
        text = self.context(question)
        one = complete_column(self.spark.createDataFrame([(text,)], "prompt string"), "prompt", "answer", self.complete)
        return one.first()["answer"]

    # -- projects
    def statistics(self) -> DataFrame:
        return stats.schema_info(self.spark, self.folder)

    def projects(self) -> DataFrame:
        """Projects with their stored files, entities and chunks."""
        counts = []
        for name, label in (("parsed_files", "n_files"), ("code_entities", "n_entities"), ("code_chunks", "n_chunks"), ("documents", "n_documents")):
            df = self._read(name)
            if df is not None:
                counts.append(df.groupBy("project_name").agg(F.count("*").alias("n")).withColumn("what", F.lit(label)))
        if not counts:
            return self.spark.createDataFrame([], "project_name string, n_files long, n_entities long, n_chunks long, n_documents long")
        got = counts[0]
        for x in counts[1:]:
            got = got.unionByName(x)
        labels = ["n_files", "n_entities", "n_chunks", "n_documents"]
        return got.groupBy("project_name").agg(*[F.coalesce(F.sum(F.when(F.col("what") == c, F.col("n"))), F.lit(0)).alias(c) for c in labels])

    def _forget(self, name: str, gone) -> int:
        df = self._read(name)
        if df is None:
            return 0
        hit = F.coalesce(gone, F.lit(False))
        n = df.where(hit).count()
        if n:
            swap(df.where(~hit), self._path(name))
        return n

    def delete_project(self, project: str) -> dict[str, int]:
        """Take all of a project out: files, entities, chunks, documents and their sections; rows removed by table.

        Sections of stores without their project column go with the documents they belong to.
        """
        removed = {}
        sections, docs = self._read("document_chunks"), self._read("documents")
        if sections is not None and docs is not None and "project_name" not in sections.columns:
            mine = cut_lineage(docs.where(F.col("project_name") == project).select("path").distinct())
            kept = sections.join(mine, "path", "left_anti")
            removed["document_chunks"] = sections.count() - kept.count()
            swap(kept, self._path("document_chunks"))
        else:
            removed["document_chunks"] = self._forget("document_chunks", F.col("project_name") == project)
        for name in ("parsed_files", "code_entities", "code_chunks", "documents"):
            removed[name] = self._forget(name, F.col("project_name") == project)
        return removed

    def delete_index(self, prefix: str) -> dict[str, int]:
        """Take out all whose path lies under ``prefix``: files, entities and chunks; rows removed by table."""
        under = lambda c: F.startswith(F.col(c), F.lit(prefix.rstrip("/") + "/")) | (F.col(c) == prefix)
        columns = {"parsed_files": "path", "code_entities": "file_path", "code_chunks": "file_path", "documents": "path", "document_chunks": "path"}
        return {name: self._forget(name, under(c)) for name, c in columns.items()}

    def clear(self) -> None:
        """Empty every stored table."""
        for name in ("parsed_files", "code_entities", "code_chunks", "documents", "document_chunks"):
            df = self._read(name)
            if df is not None:
                swap(df.limit(0), self._path(name))
