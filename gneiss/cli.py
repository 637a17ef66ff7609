"""Commands: index, sync, query, blast-radius, git-analyze, hotspots, snapshot, drift, serve, install."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import replace

from gneiss.operators import graph
from gneiss.plans import answers, config, index, project
from gneiss.sources import layout

TOOLS = {
    "search": ("Nearest symbols to a question", {"query": "string", "top_k": "integer", "module": "string"}, ["query"]),
    "blast_radius": ("Transitive callers of a symbol", {"symbol": "string", "depth": "integer"}, ["symbol"]),
    "callers": ("Direct callers of a symbol", {"symbol": "string"}, ["symbol"]),
    "callees": ("Direct callees of a symbol", {"symbol": "string"}, ["symbol"]),
    "module_deps": ("Modules and what they depend on", {"module": "string"}, []),
    "hotspots": ("Files by churn and coupling", {"since_days": "integer", "top": "integer"}, []),
    "ownership": ("Files and their main authors", {"path": "string"}, []),
}


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("gneiss").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gneiss")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, store: bool = False, sources: bool = True, state: bool = False):
        c = commands.add_parser(name)
        if sources:
            c.add_argument("--repo", default=".")
            c.add_argument("--source", action="append")
        if store or state:
            c.add_argument("--state-dir")
        if store:
            for flag in ("--collection", "--db", "--db-url", "--db-file", "--embedding"):
                c.add_argument(flag)
            c.add_argument("--db-timeout", type=int)
        return c

    command("index", store=True).add_argument("--benchmark-json")
    command("sync", store=True).add_argument("--refresh-neighbours", action="store_true")
    c = command("query", store=True)
    c.add_argument("question")
    c.add_argument("--top-k", type=int, default=10)
    c.add_argument("--module")
    c = command("blast-radius")
    c.add_argument("target")
    c.add_argument("--depth", type=int, default=3)
    c = command("git-analyze", sources=False, state=True)
    c.add_argument("--repo", default=".")
    c.add_argument("--since", type=int, default=365)
    c.add_argument("--threshold", type=int, default=3)
    c = command("hotspots")
    c.add_argument("--since", type=int, default=365)
    c.add_argument("--top", type=int, default=20)
    command("snapshot", state=True).add_argument("--label")
    c = command("drift", sources=False)
    c.add_argument("a")
    c.add_argument("b")
    command("serve", store=True)
    c = command("install", sources=False)
    c.add_argument("--project-dir", default=".")
    return top


def opened(spark, args, workspace, several: bool):
    """The state folder, settings and store of a workspace."""
    state = layout.state_dir(workspace, args.state_dir, several)
    asked = config.Config(args.db, args.db_url, args.db_timeout, args.db_file, args.embedding, args.collection)
    settings = config.merge(state, asked)
    name = layout.collection_name(workspace, args.collection or settings.collection, several)
    return state, settings, index.Store(spark, settings.db_file, name), name


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "install":
        return install(args.project_dir)
    spark = spark or session()
    if args.command == "drift":
        for name, rows in answers.drift(spark, args.a, args.b).items():
            print(f"{name}:")
            for r in rows.collect():
                print("  " + "  ".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None))
        return 0
    if args.command == "git-analyze":
        state = args.state_dir or os.path.join(args.repo, ".gneiss")
        print(json.dumps(answers.analyse_history(spark, args.repo, state, args.since, args.threshold)))
        return 0
    workspaces = layout.resolve(args.repo, args.source)
    several = len(workspaces) > 1
    if args.command in ("index", "sync"):
        found = []
        for w in workspaces:
            state, settings, target, name = opened(spark, args, w, several)
            if args.command == "index":
                found.append(index.index(spark, w, state, target, settings.embedding))
                config.save(state, replace(settings, collection=name))
            else:
                try:
                    found.append(index.sync(spark, w, state, target, settings.embedding, args.refresh_neighbours))
                except FileNotFoundError as e:
                    print(f"{e}: run index first", file=sys.stderr)
                    return 1
            print(json.dumps(found[-1]))
        if args.command == "index" and args.benchmark_json:
            os.makedirs(os.path.dirname(os.path.abspath(args.benchmark_json)), exist_ok=True)
            keys = ("parsedFiles", "unresolvedCalls", "indexedSymbols")
            total = {"schemaVersion": 1, "workspaces": found, "totalWallNanos": sum(v for f in found for k, v in f.items() if k.endswith("Nanos")), **{f"total{k[0].upper()}{k[1:]}": sum(f[k] for f in found) for k in keys}}
            with open(args.benchmark_json, "w", encoding="utf-8") as f:
                json.dump(total, f, indent=2)
        return 0
    first = workspaces[0]
    if args.command == "query":
        _, settings, target, _ = opened(spark, args, first, several)
        hits = target.search(args.question, settings.embedding, args.top_k, args.module).collect()
        for r in hits:
            print(f"{r['score']:.4f}  {r['content'].splitlines()[0]}")
        if not hits:
            print("No results." + (" The module may hold none; try without --module." if args.module else ""))
        return 0
    if args.command == "blast-radius" and several:
        print("give a repository with one workspace", file=sys.stderr)
        return 1
    built = project.build(spark, first)
    if args.command == "blast-radius":
        target = answers.find(built, args.target)
        if target is None:
            print(f"Symbol not found: {args.target}", file=sys.stderr)
            return 1
        for r in graph.reachable(built.edges, target, args.depth).orderBy("depth", "id").collect():
            print(f"{r['depth']}  {r['id']}")
    elif args.command == "hotspots":
        for r in answers.hotspots(spark, built, first.root, args.since, args.top).collect():
            print(f"{r['score']:>8}  {r['churn']:>6}  {r['coupling']:>6}  {r['file']}")
    elif args.command == "snapshot":
        print(answers.save_snapshot(spark, built, first, layout.state_dir(first, args.state_dir, several), args.label))
    elif args.command == "serve":
        state, settings, target, _ = opened(spark, args, first, several)
        serve(answers.Tools(spark, first, built, state, target, settings.embedding), sys.stdin, sys.stdout)
    return 0


def serve(tools: answers.Tools, lines, out) -> None:
    """Answer JSON-RPC requests, one to a line: initialize, tools/list, tools/call."""
    for line in lines:
        if not line.strip():
            continue
        request = json.loads(line)
        reply = {"jsonrpc": "2.0", "id": request.get("id")}
        method, params = request.get("method"), request.get("params") or {}
        if "id" not in request:
            continue
        if method == "initialize":
            reply["result"] = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "gneiss", "version": "0.1"}}
        elif method == "tools/list":
            reply["result"] = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}, "required": r}} for n, (d, p, r) in TOOLS.items()]}
        elif method == "tools/call" and params.get("name") in TOOLS:
            answer = getattr(tools, params["name"])(**(params.get("arguments") or {}))
            failed = isinstance(answer, dict) and "error" in answer
            reply["result"] = {"content": [{"type": "text", "text": json.dumps(answer)}], "isError": failed}
        else:
            reply["error"] = {"code": -32601, "message": f"unknown: {method}"}
        print(json.dumps(reply), file=out, flush=True)


def install(folder: str) -> int:
    """Name the server in the project's tool settings, beside what they hold."""
    path = os.path.join(folder, ".mcp.json")
    settings = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
    settings.setdefault("mcpServers", {})["gneiss"] = {"command": sys.executable, "args": ["-m", "gneiss.cli", "serve", "--repo", "."]}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings, f, indent=2)
    print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
