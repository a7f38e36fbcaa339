"""A read-only tool server over standard input and output: JSON-RPC 2.0, one message a line, as the Model Context Protocol has it."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from loam.api import ArgumentError, Tools

PROTOCOL = "2024-11-05"
_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}
TOOLS = [
    {
        "name": "search",
        "description": "Full-text search over the indexed files.",
        "inputSchema": {
            "type": "object", "required": ["query"],
            "properties": {"query": _TEXT, "limit": _NUMBER | {"default": 10}, "offset": _NUMBER | {"default": 0}, "ext": {"type": ["string", "array"], "items": _TEXT}, "sort": {"type": "string", "enum": ["relevance", "mtime", "size"]}},
        },
    },
    {"name": "preview", "description": "The part of one file that fits a query best.", "inputSchema": {"type": "object", "required": ["path"], "properties": {"path": _TEXT, "query": _TEXT}}},
    {"name": "index_status", "description": "Documents, roots and age of the index.", "inputSchema": {"type": "object", "properties": {}}},
]
# JSON-RPC's error codes.
PARSE, REQUEST, METHOD, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603


class ProtocolError(Exception):
    def __init__(self, code: int, text: str):
        super().__init__(text)
        self.code = code


class Server:
    """Answers messages with the tools' dictionaries. Bad arguments are protocol errors; what the tools answer with an error is a tool's result."""

    def __init__(self, tools: Tools):
        self.tools = tools

    def call(self, name: str, arguments: dict) -> dict:
        allowed = {t["name"]: t["inputSchema"] for t in TOOLS}
        if name not in allowed:
            raise ProtocolError(PARAMS, f"there is no tool {name!r}")
        schema = allowed[name]
        unknown, missing = set(arguments) - set(schema["properties"]), [k for k in schema.get("required", ()) if k not in arguments]
        if unknown or missing:
            raise ProtocolError(PARAMS, f"unknown arguments {sorted(unknown)}" if unknown else f"missing arguments {missing}")
        try:
            result = getattr(self.tools, name)(**arguments)
        except (ArgumentError, TypeError) as e:
            raise ProtocolError(PARAMS, str(e)) from e
        return {"content": [{"type": "text", "text": json.dumps(result, ensure_ascii=False)}], "structuredContent": result, "isError": "error" in result}

    def answer(self, message: dict) -> dict | None:
        """The answer to one message; None for a notification."""
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return {"jsonrpc": "2.0", "id": message.get("id") if isinstance(message, dict) else None, "error": {"code": REQUEST, "message": "no request of JSON-RPC 2.0"}}
        if "id" not in message:
            return None
        params = message.get("params") or {}
        try:
            if message["method"] == "initialize":
                result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "loam", "version": "2"}}
            elif message["method"] == "ping":
                result = {}
            elif message["method"] == "tools/list":
                result = {"tools": TOOLS}
            elif message["method"] == "tools/call":
                result = self.call(params.get("name"), params.get("arguments") or {})
            else:
                raise ProtocolError(METHOD, f"there is no method {message['method']!r}")
        except ProtocolError as e:
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": e.code, "message": str(e)}}
        except Exception as e:  # a failing query must not end the server
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": INTERNAL, "message": str(e).split("\n")[0]}}
        return {"jsonrpc": "2.0", "id": message["id"], "result": result}

    def serve(self, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
        for line in source:
            if not line.strip():
                continue
            try:
                message = json.loads(line)
            except ValueError:
                out = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": "not JSON"}}
            else:
                out = self.answer(message)
            if out is not None:
                print(json.dumps(out, ensure_ascii=False), file=sink, flush=True)
