"""Command line: index, docs, query, search, callers, status, delete; and a JSON-RPC server over standard input."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from .api import Engine
from .errors import EngineError
from .session import session

TOOLS = {
    "index_repository": ("Index a folder", {"path": "string", "project": "string"}),
    "query_code_graph": ("Answer a question from graph and search", {"question": "string"}),
    "get_code_snippet": ("Source of an entity", {"qualified_name": "string"}),
    "semantic_search": ("Entities like a text", {"query": "string", "limit": "integer"}),
}


def call_tool(engine: Engine, name: str, args: dict):
    if name == "index_repository":
        return engine.index(args["path"], args["project"])
    if name == "query_code_graph":
        return [r.asDict() for r in engine.query(args["question"]).collect()]
    if name == "get_code_snippet":
        from pyspark.sql import functions as F

        from .operators.graph import nodes

        n = nodes(engine.spark, engine.folder, "code", "file_path", "start_line", "end_line")
        row = n.where(F.col("qualified_name") == F.lit(args["qualified_name"])).first()
        return row.asDict() if row else {"error": "no such entity"}
    if name == "semantic_search":
        return [r.asDict() for r in engine.search(args["query"], args.get("limit", 5)).collect()]
    raise KeyError(name)


def handle(engine: Engine, request: dict) -> dict | None:
    """The answer to one JSON-RPC request: initialize, tools/list, tools/call, shutdown; None for a notification."""
    ident, method, params = request.get("id"), request.get("method"), request.get("params") or {}
    ok = lambda r: {"jsonrpc": "2.0", "id": ident, "result": r}
    err = lambda code, text: {"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": text}}
    if ident is None:
        return None
    if method == "initialize":
        return ok({"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "sparkloom", "version": "1"}})
    if method == "tools/list":
        return ok({"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}}} for n, (d, p) in TOOLS.items()]})
    if method == "shutdown":
        return ok(None)
    if method != "tools/call":
        return err(-32601, f"unknown method {method}")
    if params.get("name") not in TOOLS:
        return err(-32602, f"unknown tool {params.get('name')}")
    try:
        got = call_tool(engine, params["name"], params.get("arguments") or {})
        return ok({"content": [{"type": "text", "text": json.dumps(got, default=str)}]})
    except KeyError as e:
        return err(-32602, f"missing argument {e}")
    except Exception as e:  # noqa: BLE001 - a failing tool must not end the server
        return err(-32603, str(e))


def serve(engine: Engine, lines, out) -> None:
    for line in lines:
        try:
            request = json.loads(line)
        except ValueError:
            continue
        answer = handle(engine, request)
        if answer is not None:
            print(json.dumps(answer), file=out, flush=True)
        if request.get("method") == "shutdown":
            return


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom")
    p.add_argument("--data", required=True, help="folder of the stored tables")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, args in {"index": ("path", "project"), "docs": ("path", "project"), "query": ("question",), "search": ("text",), "callers": ("name",), "callees": ("name",), "explain": ("name",), "path": ("source", "target"), "search-docs": ("text",), "projects": (), "settings": (), "status": (), "delete": ("project",), "delete-index": ("prefix",), "clear": (), "serve": ()}.items():
        s = sub.add_parser(verb)
        for a in args:
            s.add_argument(a)
        if verb in ("query", "search", "search-docs"):
            s.add_argument("--limit", type=int)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    engine = Engine(session("cli"), a.data)
    show = lambda df: [print(r) for r in df.toJSON().collect()]  # noqa: E731 - answers are limited
    try:
        if a.verb == "index":
            print(json.dumps(engine.index(a.path, a.project)))
        elif a.verb == "docs":
            print(json.dumps({"documents": engine.index_documents(a.path, a.project)}))
        elif a.verb == "query":
            show(engine.query(a.question, a.limit))
        elif a.verb == "search":
            show(engine.search(a.text, a.limit))
        elif a.verb in ("callers", "callees"):
            show(getattr(engine, a.verb)(a.name))
        elif a.verb == "status":
            show(engine.statistics())
        elif a.verb == "explain":
            print(json.dumps(engine.explain_entity(a.name), default=str))
        elif a.verb == "path":
            show(engine.find_call_path(a.source, a.target))
        elif a.verb == "search-docs":
            show(engine.search_documents(a.text, a.limit))
        elif a.verb == "projects":
            show(engine.projects())
        elif a.verb == "settings":
            print(json.dumps(asdict(engine.settings), default=str))
        elif a.verb == "delete":
            print(json.dumps(engine.delete_project(a.project)))
        elif a.verb == "delete-index":
            print(json.dumps(engine.delete_index(a.prefix)))
        elif a.verb == "clear":
            engine.clear()
        else:
            serve(engine, sys.stdin, sys.stdout)
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
