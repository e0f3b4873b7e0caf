"""The engine from a console, and as tools over standard input and output.

``python -m lodestone.commands index|search|status|serve --root DIR``. An
index lies in the user's folder, under the hash of its root's path.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import logging
import os
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import SparkSession

from lodestone.plans import finder
from lodestone.plans.finder import DEFAULT_LIMIT, Filters
from lodestone.plans.indexer import Indexer
from lodestone.plans.store import IndexStore, ProjectMetadata
from lodestone.session import build_session
from lodestone.sources.embeddings import DEFAULT_BASE, HttpProvider, Provider

LOG = logging.getLogger("lodestone")
LEVELS = {"debug": logging.DEBUG, "warn": logging.WARNING, "warning": logging.WARNING, "error": logging.ERROR}


class NoIndex(RuntimeError):
    pass


def data_dir(root: str, home: str | None = None) -> str:
    """A project's folder: the first 16 hex digits of its absolute path's SHA-256 below the user's folder."""
    whole = os.path.abspath(root)
    return os.path.join(home or os.path.expanduser("~/.lodestone"), "projects", hashlib.sha256(whole.encode()).hexdigest()[:16])


def log_level(given: str = "") -> int:
    return LEVELS.get((given or os.environ.get("LODESTONE_LOG", "")).lower(), logging.INFO)


def env_int(name: str) -> int:
    """An integer of the environment; 0 where it's unset or something else."""
    try:
        return int(os.environ.get(name, ""))
    except ValueError:
        return 0


def flexible_int(value: int | str | None) -> int | None:
    """A number, or one in a string; an empty string is none, other text a ValueError."""
    if value is None or value == "":
        return None
    if isinstance(value, bool) or isinstance(value, float) and value != int(value):
        raise ValueError(f"not an integer: {value!r}")
    return int(value)


def split_comma(text: str) -> list[str]:
    return [x for x in (p.strip() for p in (text or "").split(",")) if x]


def shortened(text: str, most: int) -> str:
    """At most so many bytes of a text for the log, and a mark where more was there."""
    raw = text.encode("utf-8")
    return text if most <= 0 or len(raw) <= most else raw[:most].decode("utf-8", "replace") + "…"


def provider() -> tuple[Provider, int] | None:
    """The embedding service of the environment and its dimension, if one is named and answers."""
    own = HttpProvider()
    if not own.key and own.base == DEFAULT_BASE:
        return None
    try:
        return own, len(own.embed(["x"])[0])
    except Exception as e:  # whatever the service does, keyword search goes on
        LOG.warning("embeddings disabled: %s", e)
        return None


def open_store(spark: SparkSession, root: str, home: str | None = None) -> IndexStore:
    folder = f"{data_dir(root, home)}/index"
    if not IndexStore.exists(spark, folder):
        raise NoIndex(f"index not found for root: {root}")
    return IndexStore(spark, folder)


# ---- commands ------------------------------------------------------------------


def run_index(spark: SparkSession, root: str, home: str | None = None, own: Provider | None = None, max_size: int = 0) -> dict:
    indexer = Indexer(spark, os.path.abspath(root), data_dir(root, home), own, max_size)
    LOG.info("indexed %s: %s", root, indexer.run())
    return indexer.status()


def status_text(spark: SparkSession, root: str, as_json: bool, home: str | None = None) -> str:
    now = open_store(spark, root, home).status()
    data = ProjectMetadata(spark, data_dir(root, home)).read() or {}
    rows = {"files": now["files"], "chunks": now["chunks"]}
    rows |= {k: v for k, v in (("last_accessed_at", data.get("lastAccessedAt")), ("idf_rebuild_completed_at", data.get("idfRebuildCompletedAt"))) if v}
    return json.dumps(rows, separators=(",", ":")) if as_json else "\n".join(f"{k}: {v}" for k, v in rows.items())


def search_text(spark: SparkSession, root: str, query: str, limit: int, filters: Filters, content: bool, as_json: bool, home: str | None = None, own: Provider | None = None) -> str:
    """What a search prints; an empty result in JSON prints nothing. ValueError without search terms."""
    store = open_store(spark, root, home)
    found = finder.find(store, query, limit, filters, own)
    if found.message == finder.NO_TERMS:
        raise ValueError(finder.NO_TERMS)
    if found.message:
        return "" if as_json else found.message
    whole = os.path.abspath(root)
    return finder.as_json(store, found.results, whole, content) if as_json else finder.as_markdown(store, found.results, whole, content)


# ---- tools ------------------------------------------------------------------------

_STRINGS = {"type": "array", "items": {"type": "string"}}
TOOLS = [
    {
        "name": "codebase_search",
        "description": "Ranked keyword search of the indexed files, fused with vectors where there are any; paths and, on request, content.",
        "inputSchema": {
            "type": "object",
            "required": ["query"],
            "properties": {
                "query": {"type": "string"}, "limit": {"type": ["integer", "string"]}, "file_extensions": _STRINGS, "path_filter": {"type": "string"},
                "exclude_paths": _STRINGS, "include_content": {"type": "boolean"},
            },
        },
    },
    {"name": "codebase_index_status", "description": "Whether a run goes on, its progress, and counts of files and chunks.", "inputSchema": {"type": "object"}},
]


def tool_search(indexer: Indexer, args: dict, own: Provider | None = None) -> str:
    """A limit that is absent or not above 0 means the default; an empty exclusion excludes every path."""
    limit = flexible_int(args.get("limit")) or 0
    limit = limit if limit > 0 else DEFAULT_LIMIT
    LOG.info("search %s, limit %d", shortened(args.get("query") or "", 80), limit)
    filters = Filters(args.get("path_filter") or "", args.get("file_extensions") or [], args.get("exclude_paths") or [])
    found = finder.find(indexer.store, args.get("query") or "", limit, filters, own)
    return found.message or finder.as_markdown(indexer.store, found.results, indexer.root, bool(args.get("include_content")))


def tool_status(indexer: Indexer) -> str:
    now = indexer.status()
    return "".join(f"{k}: {str(v).lower() if isinstance(v, bool) else v}\n" for k, v in now.items())


def answer(indexer: Indexer, request: dict, own: Provider | None = None) -> dict | None:
    """The answer to one request of the tool protocol (JSON-RPC 2.0); None to a notification."""
    if "id" not in request:
        return None
    calls: dict[str, Callable[[dict], dict]] = {
        "initialize": lambda p: {"protocolVersion": p.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "0.1.0"}},
        "ping": lambda p: {},
        "tools/list": lambda p: {"tools": TOOLS},
        "tools/call": lambda p: _called(indexer, p.get("name"), p.get("arguments") or {}, own),
    }
    call = calls.get(request.get("method"))
    if call is None:
        return {"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32601, "message": "method not found"}}
    return {"jsonrpc": "2.0", "id": request["id"], "result": call(request.get("params") or {})}


def _called(indexer: Indexer, name: str | None, args: dict, own: Provider | None) -> dict:
    try:
        if name == "codebase_search":
            text = tool_search(indexer, args, own)
        elif name == "codebase_index_status":
            text = tool_status(indexer)
        else:
            raise ValueError(f"unknown tool: {name}")
    except Exception as e:
        LOG.error("tool failed: %s", e)
        return {"isError": True, "content": [{"type": "text", "text": str(e)}]}
    return {"content": [{"type": "text", "text": text}]}


def serve(indexer: Indexer, lines: TextIO, out: TextIO, own: Provider | None = None) -> None:
    """Answer requests, one a line, until the input ends."""
    for line in lines:
        if line.strip():
            try:
                reply = answer(indexer, json.loads(line), own)
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
            if reply is not None:
                out.write(json.dumps(reply, ensure_ascii=False) + "\n")
                out.flush()


# ---- console ------------------------------------------------------------------------


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--root", default=".")
    p.add_argument("--json", action="store_true")
    p.add_argument("--log-level", default="")
    p.add_argument("--home", default=None, help="where indexes lie, instead of the user's folder")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("--max-size", type=int, default=0)
    sub.add_parser("status")
    sub.add_parser("serve")
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=DEFAULT_LIMIT)
    search.add_argument("--include-content", action="store_true")
    search.add_argument("--ext", default="")
    search.add_argument("--path-filter", default="")
    search.add_argument("--exclude", default="")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 without an index or without search terms."""
    args = _parser().parse_args(argv)
    logging.basicConfig(level=log_level(args.log_level), stream=sys.stderr)
    spark = spark or build_session("lodestone")
    own = provider() if args.command in ("index", "search", "serve") else None
    service = own[0] if own else None
    try:
        if args.command == "index":
            now = run_index(spark, args.root, args.home, service, args.max_size)
            text = f"indexed files: {now['files']}, chunks: {now['chunks']}"
        elif args.command == "status":
            text = status_text(spark, args.root, args.json, args.home)
        elif args.command == "serve":
            serve(Indexer(spark, os.path.abspath(args.root), data_dir(args.root, args.home), service), sys.stdin, sys.stdout, service)
            return 0
        else:
            filters = Filters(args.path_filter, split_comma(args.ext), split_comma(args.exclude))
            text = search_text(spark, args.root, args.query, args.limit, filters, args.include_content, args.json, args.home, service)
    except (NoIndex, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    if text:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
