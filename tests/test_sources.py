"""Scans, parsers, streams and the engine on files made for the test."""

import io
import json

import pytest

from sparkloom.api import Engine
from sparkloom.operators.graph import calls
from sparkloom.cli import handle, serve
from sparkloom.errors import QueryError
from sparkloom.sources.files import scan, scan_documents, statistics
from sparkloom.sources.parsers import python_entities, python_imports, script_entities, script_imports
from sparkloom.sources.types import local_types, name_score
from sparkloom.streaming.watch import maintain, relevant, stream, vanished

PY = '''import os
from .models import User as U, Role


class Service(U):
    """Keeps users."""

    async def load(self, name: str) -> User:
        """Load one."""
        user = Role()
        return self.find(name)

    @staticmethod
    def find(name):
        return os.path.join(name)


def top(service):
    def inner():
        return service.load("x")
    return Service().find(inner)
'''
JS = """import d, { a as b, c } from './mod';
import * as ns from 'lib';
const { q } = require('req');
/** Opens it. */
export async function open(x) { return go(x, "a { b"); }
const arrow = (y) => { new Thing(y).run(); };
export class Box extends Base {
  /** Puts it. */
  static put(z) { if (z) { this.keep(z); } }
  get size() { return 1; }
}
"""


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for name, text in {"pkg/__init__.py": "", "pkg/service.py": PY, "web/app.js": JS, "node_modules/x/i.js": "x", "a.egg-info/s.py": "x", "notes.txt": "x", "docs/guide.md": "# Guide\n\nSee `Service`.\n"}.items():
        f = root / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return root


def test_scan(spark, repo):
    got = {r["relative_path"]: r for r in scan(spark, str(repo)).collect()}
    assert set(got) == {"pkg/__init__.py", "pkg/service.py", "web/app.js"}
    assert got["pkg/service.py"]["line_count"] == PY.count("\n") + 1 and got["web/app.js"]["language"] == "javascript" and len(got["web/app.js"]["content_hash"]) == 64
    assert statistics(scan(spark, str(repo))).first()["n_files"] == 3
    assert [r["relative_path"] for r in scan_documents(spark, str(repo)).collect()] == ["docs/guide.md"]


def test_python_parser():
    got = {r[2]: r for r in python_entities(PY)}
    assert set(got) == {"Service", "Service.load", "Service.find", "top"}
    assert got["Service"][12] == ["U"] and got["Service"][5] == "Keeps users." and got["Service.load"][8] and got["Service.find"][9] and got["Service.load"][0] == "method"
    assert set(got["top"][13]) == {"service.load", "Service().find", "Service"} and (got["top"][6], got["top"][7]) == (18, 21)
    assert [(r[0], r[1], r[2], r[3]) for r in python_imports(PY)] == [("os", None, None, True), ("Role", None, ".models", False), ("User", "U", ".models", False)]


def test_script_parser():
    got = {r[2]: r for r in script_entities(JS)}
    assert set(got) == {"open", "arrow", "Box", "Box.put", "Box.size"}
    assert got["open"][8] and got["open"][5] == "/** Opens it. */" and got["open"][13] == ["go"] and got["Box"][12] == ["Base"] and got["Box.put"][9] and got["Box.put"][13] == ["this.keep"] and got["Box.put"][5] == "/** Puts it. */"
    assert {(r[0], r[1], r[2]) for r in script_imports(JS)} == {("d", None, "./mod"), ("a", "b", "./mod"), ("c", None, "./mod"), ("*", "ns", "lib"), ("q", None, "req")}


def test_types():
    got = {(f, n): (t, h) for f, n, t, h, _ in local_types("class Order: pass\ndef f(a: int, order, x):\n    y = Order()\n    z = y\n    self.k = 'a'\n    w: list[int] = []\n")}
    assert got["f", "a"] == ("int", "annotation") and got["f", "order"] == ("Order", "name") and got["f", "y"] == got["f", "z"] == ("Order", "constructor") and got["f", "self.k"][0] == "str" and got["f", "w"][0] == "list[int]" and ("f", "x") not in got
    assert name_score("order", "Order") == 100 and name_score("new_order", "Order") == 90 and name_score("x", "Order") == 0


def test_engine_is_incremental(spark, repo, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    assert e.index(str(repo), "p") == {"files": 3, "entities": 9}
    assert e.index(str(repo), "p") == {"files": 0, "entities": 0}
    (repo / "web/app.js").write_text("function only() { return top(); }\n")
    (repo / "pkg/__init__.py").unlink()
    assert e.index(str(repo), "p") == {"files": 1, "entities": 1}
    ents = {r["qualified_name"] for r in spark.read.parquet(str(tmp_path / "store/code_entities.parquet")).collect()}
    assert ents == {"p.pkg.service.Service", "p.pkg.service.Service.load", "p.pkg.service.Service.find", "p.pkg.service.top", "p.web.app.only"}
    assert spark.read.parquet(str(tmp_path / "store/parsed_files.parquet")).count() == 2
    assert e.entity("Service").first()["qualified_name"] == "p.pkg.service.Service"
    assert e.plan("who calls `top`?")["intent"] == "find_callers"
    assert e.search("load one user").count() > 0 and e.query("explain `Service`").first()["qualified_name"] == "p.pkg.service.Service"
    assert e.answer("where is `Service`?").startswith("# where is")
    shown = e.context("where is `Service`?")
    assert "- p.pkg.service.Service (Class)" in shown and "class Service(U):" in shown
    with pytest.raises(QueryError):
        e.plan("  ")
    assert e.index_documents(str(repo), "p") == 1 and e.index_documents(str(repo), "p") == 0
    call = lambda m, **p: handle(e, {"jsonrpc": "2.0", "id": 1, "method": m, "params": p})
    assert len(call("tools/list")["result"]["tools"]) == 4 and call("nope")["error"]["code"] == -32601 and call("tools/call", name="x")["error"]["code"] == -32602
    assert call("tools/call", name="get_code_snippet", arguments={})["error"]["code"] == -32602
    shown = json.loads(call("tools/call", name="get_code_snippet", arguments={"qualified_name": "p.pkg.service.top"})["result"]["content"][0]["text"])
    assert shown["code"].startswith("def top(service):")
    out = io.StringIO()
    serve(e, ['{"id": 1, "method": "initialize"}', "junk", '{"method": "note"}', '{"id": 2, "method": "shutdown"}', '{"id": 3, "method": "initialize"}'], out)
    assert len(out.getvalue().splitlines()) == 2
    e.delete_project("p")
    assert spark.read.parquet(str(tmp_path / "store/code_entities.parquet")).count() == 0


def test_engine_stores_vectors_and_forgets_them(spark, repo, tmp_path):
    def embed(texts):
        from sparkloom.functions.ports import hashing_embedder

        return hashing_embedder()(texts)

    e = Engine(spark, str(tmp_path / "store"), embed=embed)
    e.index(str(repo), "p")
    chunks = e._read("code_chunks")
    n = chunks.count()
    assert n and chunks.where("embedding IS NULL OR content_hash IS NULL").isEmpty()
    assert {r[0] for r in chunks.select("qualified_name").distinct().collect()} == {r[0] for r in e._read("code_entities").select("qualified_name").collect()}
    before = {r["chunk_id"]: r["content_hash"] for r in chunks.collect()}
    path = chunks.first()["file_path"]
    e.index(str(repo), "p")  # nothing changed: nothing is embedded again
    assert {r["chunk_id"]: r["content_hash"] for r in e._read("code_chunks").collect()} == before
    assert e.count_vectors(path) == e._read("code_chunks").where(f"file_path = '{path}'").count()
    hits = e.search(e._read("code_chunks").first()["content"], 5)
    assert hits.first()["score"] > 0.99 and path not in {r["file_path"] for r in e.search("x", 50, exclude_file=path).collect()}
    assert {r["node_type"] for r in e.search("x", 50, entity_type="function").collect()} <= {"Function"}
    assert e.search("x", project="other").isEmpty()
    name = e._read("code_entities").where("type = 'function'").first()["qualified_name"]
    assert e.explain_entity(name)["qualified_name"] == name
    (repo / "guide.md").write_text("# Guide\n\nHow to load files.\n")
    e.index_documents(str(repo), "p")
    assert e.search_documents("How to load files").first()["heading_path"] == ["Guide"]
    assert e.search_documents("x", project="other").isEmpty()
    assert e.projects().first()["n_chunks"] == n
    removed = e.delete_index(path)
    assert removed["parsed_files"] == 1 and e.count_vectors(path) == 0
    assert e.delete_project("p")["document_chunks"] >= 1
    assert all(e._read(t).isEmpty() for t in ("parsed_files", "code_entities", "code_chunks", "documents", "document_chunks"))
    e.clear()


def test_call_paths_of_the_engine(spark, repo, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.index(str(repo), "p")
    edges = [tuple(r) for r in calls(spark, e.folder).collect()]
    if edges:
        src, dst = edges[0]
        got = e.find_call_path(src, dst).collect()
        assert got and got[0]["length"] == 1 and got[0]["path"] == f"{src} > {dst}"


def test_stream_upserts_are_idempotent(spark, tmp_path):
    schema = "path string, at int, body string, gone boolean"
    box, target = str(tmp_path / "in"), str(tmp_path / "table")
    like = spark.createDataFrame([], schema)

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(box)
        maintain(stream(spark, box, like), target, "path", "at", str(tmp_path / "state"), "gone").awaitTermination()
        return {r["path"]: r["body"] for r in spark.read.parquet(target).collect()}

    assert feed([("a.py", 1, "x", False), ("a.py", 2, "y", False), ("b.py", 1, "z", False)]) == {"a.py": "y", "b.py": "z"}
    assert feed([("a.py", 1, "old", False), ("b.py", 5, None, True), ("c.py", 1, "n", False)]) == {"a.py": "y", "c.py": "n"}
    gone = vanished(spark.read.parquet(target), spark.createDataFrame([("a.py",)], "path string"), "path")
    assert [r[0] for r in gone.collect()] == ["c.py"]


def test_relevant_paths(spark):
    df = spark.createDataFrame([("/r/a.py",), ("/r/node_modules/a.js",), ("/r/a.md",), ("/r/x.egg-info/a.py",), ("/r/B.TSX",)], "p string")
    assert [r[0] for r in df.where(relevant(df["p"])).collect()] == ["/r/a.py", "/r/B.TSX"]
