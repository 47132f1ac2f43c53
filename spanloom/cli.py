"""Command line and line-wise JSON-RPC over the engine's API."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import api
from .operators.pack import as_json, digest

# The protocol's version, the tools and their fields.
PROTOCOL = "2024-11-05"
TOOLS = {
    "get_context": ({"query": "string", "budget_tokens": "integer", "include_palace": "boolean"}, ["query"]),
    "search_symbols": ({"name": "string", "limit": "integer"}, ["name"]),
    "search_code": ({"query": "string", "limit": "integer"}, ["query"]),
    "index_status": ({}, []),
}


def session() -> SparkSession:
    spark = SparkSession.builder.appName("spanloom").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def call_tool(spark: SparkSession, root: str, name: str, args: dict) -> object:
    if name == "get_context":
        return json.loads(as_json(api.get_context(spark, root, args["query"], args.get("budget_tokens", api.DEFAULT_BUDGET), include_drawers=args.get("include_palace"))))
    if name == "search_symbols":
        return [r.asDict() for r in api.search_symbols(spark, root, args["name"], args.get("limit", api.SEARCH_LIMIT)).drop("hit_ord").collect()]
    if name == "search_code":
        return [r.asDict() for r in api.search_code(spark, root, args["query"], args.get("limit", api.SEARCH_LIMIT)).collect()]
    return api.status(root)


def _valid(name: str, args: object) -> bool:
    fields, needed = TOOLS[name]
    kinds = {"string": str, "integer": int, "boolean": bool}
    return isinstance(args, dict) and all(k in args for k in needed) and all(k in fields and isinstance(v, kinds[fields[k]]) and not (fields[k] == "integer" and isinstance(v, bool)) for k, v in args.items())


def handle_line(spark: SparkSession, root: str, line: str) -> str | None:
    """The answer to one request line; None for notifications."""
    fail = lambda code, text, i=None: json.dumps({"jsonrpc": "2.0", "id": i, "error": {"code": code, "message": text}})
    try:
        request = json.loads(line)
    except ValueError:
        return fail(-32700, "parse error")
    if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
        return fail(-32600, "invalid request", request.get("id") if isinstance(request, dict) else None)
    method, params, i = request["method"], request.get("params") or {}, request.get("id")
    if "id" not in request:
        return None
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "spanloom", "version": "1"}}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in f.items()}, "required": r}} for n, (f, r) in TOOLS.items()]}
    elif method == "tools/call":
        name, args = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS or not _valid(name, args):
            return fail(-32602, "invalid params", i)
        try:
            text, bad = json.dumps(call_tool(spark, root, name, args), ensure_ascii=False), False
        except api.NotInitialized:
            text, bad = "not_initialized", True
        except Exception as e:
            return fail(-32603, f"internal error: {type(e).__name__}", i)
        result = {"content": [{"type": "text", "text": text}], "isError": bad}
    else:
        return fail(-32601, "method not found", i)
    return json.dumps({"jsonrpc": "2.0", "id": i, "result": result}, ensure_ascii=False)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spanloom")
    p.add_argument("--root")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "status", "doctor", "mcp"):
        sub.add_parser(name)
    index = sub.add_parser("index")
    index.add_argument("path", nargs="?")
    index.add_argument("--force", action="store_true")
    for name, arg in (("get-context", "query"), ("search-symbols", "name"), ("search-code", "query")):
        s = sub.add_parser(name)
        s.add_argument(arg)
        s.add_argument("--limit", type=int, default=api.SEARCH_LIMIT)
        s.add_argument("--budget", type=int, default=api.DEFAULT_BUDGET)
        s.add_argument("--json", action="store_true")
        s.add_argument("--palace", action=argparse.BooleanOptionalAction, default=None)
    a = p.parse_args(argv)
    root = str(a.root or api.find_root("."))
    try:
        if a.command == "init":
            api.init(root)
        elif a.command == "status":
            print(json.dumps(api.status(root)))
        elif a.command == "doctor":
            print(json.dumps(api.doctor(session(), root)))
        elif a.command == "index":
            print(json.dumps(api.as_dict(api.index_tree(session(), root, a.force, a.path))))
        elif a.command == "get-context":
            package = api.get_context(session(), root, a.query, a.budget, include_drawers=a.palace)
            print(as_json(package) if a.json else digest(package))
        elif a.command == "mcp":
            spark = session()
            for line in sys.stdin:
                if line.strip() and (answer := handle_line(spark, root, line)) is not None:
                    print(answer, flush=True)
        else:
            found = (api.search_symbols if a.command == "search-symbols" else api.search_code)(session(), root, getattr(a, "name", None) or getattr(a, "query", ""), a.limit)
            for r in found.collect():
                print(json.dumps(r.asDict(), ensure_ascii=False))
    except api.NotInitialized:
        print("not initialized", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
