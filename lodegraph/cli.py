"""Command line and a JSON-RPC tool server over standard input and output.

    python -m lodegraph.cli --store file:///shared/graph --source /path/to/tree index
    python -m lodegraph.cli --store file:///shared/graph query getUser --kind function
    python -m lodegraph.cli --store file:///shared/graph serve
"""

from __future__ import annotations

import argparse
import inspect
import json
import sys
from collections.abc import Callable, Iterable
from typing import TextIO

from pyspark.sql import SparkSession

from .api import Graph, Tools
from .schema import CHANGES
from .sources.files import load_config
from .streaming.watch import DEBOUNCE

_TYPES = {"str": "string", "int": "integer", "bool": "boolean"}


def tool_list(tools: Tools) -> list[dict]:
    """Name and argument schema of every tool."""
    out = []
    for name in tools.names():
        given = inspect.signature(getattr(tools, f"tool_{name}")).parameters.values()
        props = {p.name: {"type": _TYPES.get(str(p.annotation).split(" ")[0], "array")} for p in given}
        out.append({"name": name, "inputSchema": {"type": "object", "properties": props, "required": [p.name for p in given if p.default is inspect.Parameter.empty]}})
    return out


def answer(tools: Tools, line: str) -> dict | None:
    """The response to one JSON-RPC 2.0 message; None for notifications."""
    try:
        message = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
    if not isinstance(message, dict) or "id" not in message:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    try:
        if method == "initialize":
            reply["result"] = {"capabilities": {"tools": {}}, "serverInfo": {"name": "lodegraph", "version": "1"}, "protocolVersion": params.get("protocolVersion", "2024-11-05")}
        elif method == "ping":
            reply["result"] = {}
        elif method == "tools/list":
            reply["result"] = {"tools": tool_list(tools)}
        elif method == "tools/call":
            reply["result"] = {"content": [{"type": "text", "text": tools.call(params["name"], **(params.get("arguments") or {}))}]}
        else:
            reply["error"] = {"code": -32601, "message": f"no method {method}"}
    except Exception as e:  # noqa: BLE001  a failed request must not end the server
        reply["error"] = {"code": -32603, "message": str(e)}
    return reply


def serve(tools: Tools, lines: Iterable[str], out: TextIO) -> None:
    """Answer one message a line, in order."""
    for line in lines:
        if line.strip() and (reply := answer(tools, line)) is not None:
            out.write(json.dumps(reply) + "\n")
            out.flush()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodegraph")
    p.add_argument("--store", required=True, help="folder of the graph's tables")
    p.add_argument("--source", help="source tree")
    p.add_argument("--config", help="JSON file with exclude and maxFileSize")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *words: str, **options: type) -> None:
        c = sub.add_parser(name)
        for w in words:
            c.add_argument(w)
        for o, t in options.items():
            c.add_argument(f"--{o}", **({"action": "store_true"} if t is bool else {"type": t}))

    add("init", index=bool)
    add("index", force=bool)
    add("sync")
    add("watch", "log", "checkpoint", once=bool)
    add("status")
    add("overview")
    add("query", "text", kind=str, limit=int)
    add("semantic", "text", limit=int)
    add("context", "text", nodes=int, style=str)
    add("tool", "name", "arguments")
    add("serve")
    return p


def run(args: argparse.Namespace, spark: SparkSession, out: TextIO = sys.stdout, lines: Iterable[str] = sys.stdin) -> None:
    """Carry out a parsed command line."""
    config = load_config(args.config) if args.config else None
    made = args.command in ("init", "index")
    g = Graph.init(spark, args.store, args.source, False, config) if made else Graph.open(spark, args.store, args.source, config)
    tools = Tools(g)

    def some(**options) -> dict:  # noqa: ANN003
        return {k: v for k, v in options.items() if v is not None}

    def watch() -> str:
        log = spark.readStream.schema(CHANGES).json(args.log)
        g.watch(log, args.checkpoint, args.once).awaitTermination()
        return f"followed {args.log}, bursts end after {DEBOUNCE}"

    commands: dict[str, Callable[[], object]] = {
        "init": lambda: g.index() if args.index else "ready",
        "index": lambda: g.index(args.force),
        "sync": g.sync,
        "watch": watch,
        "status": tools.tool_status,
        "overview": tools.tool_overview,
        "query": lambda: tools.tool_search(args.text, **some(kind=args.kind, limit=args.limit)),
        "semantic": lambda: tools.tool_semantic(args.text, **some(limit=args.limit)),
        "context": lambda: tools.tool_context(args.text, **some(max_nodes=args.nodes, style=args.style)),
        "tool": lambda: tools.call(args.name, **json.loads(args.arguments)),
        "serve": lambda: serve(tools, lines, out),
    }
    said = commands[args.command]()
    if said is not None:
        out.write((said if isinstance(said, str) else json.dumps(said)) + "\n")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(args, SparkSession.builder.appName("lodegraph").getOrCreate())


if __name__ == "__main__":
    main()
