"""JSON-RPC over framed standard streams: the engine's tools, resources and prompt for a client process."""

from __future__ import annotations

import inspect
import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame

from marginalia.engine import Engine, ToolError

NO_METHOD, BAD_ARGUMENTS, FAILED = -32601, -32602, -32603
RESOURCES = ("notes://manifest", "notes://config", "notes://reindex/status")
MOST_ROWS = 500


def read_message(stream) -> dict | None:
    """The next message; None at the end of the stream."""
    size = None
    while True:
        line = stream.readline()
        if not line:
            return None
        if not line.strip():
            break
        name, _, value = line.decode("ascii", "replace").partition(":")
        if name.strip().lower() == "content-length":
            size = int(value)
    return json.loads(stream.read(size)) if size else {}


def write_message(stream, message: dict) -> None:
    data = json.dumps(message, default=str).encode()
    stream.write(b"Content-Length: %d\r\n\r\n" % len(data) + data)
    stream.flush()


def plain(value):
    """A result as JSON values; of a table at most a page of rows."""
    if isinstance(value, DataFrame):
        return [r.asDict(recursive=True) for r in value.limit(MOST_ROWS).collect()]
    return asdict(value) if is_dataclass(value) else value


def tool_list(engine: Engine) -> list[dict]:
    out = []
    for name in engine.TOOLS:
        f = getattr(engine, name)
        out.append({"name": name, "description": inspect.getdoc(f) or name.replace("_", " "), "inputSchema": {"type": "object", "properties": {p: {} for p in inspect.signature(f).parameters}}})
    return out


def handle(engine: Engine, message: dict) -> dict | None:
    """The answer to a message; None for a notification."""
    method, params, key = message.get("method", ""), message.get("params") or {}, message.get("id")
    if key is None:
        return None
    try:
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}, "prompts": {}}, "serverInfo": {"name": "marginalia", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": tool_list(engine)}
        elif method == "tools/call":
            arguments = dict(params.get("arguments") or {})
            first = (arguments.pop("query"),) if params.get("name") == "query_notes" and "query" in arguments else ()
            value = plain(engine.call(params.get("name", ""), **arguments) if not first else engine.query_notes(*first, **arguments))
            result = {"content": [{"type": "text", "text": json.dumps(value, default=str)}], "isError": False}
        elif method == "resources/list":
            result = {"resources": [{"uri": u, "name": u} for u in RESOURCES]}
        elif method == "resources/read":
            result = {"contents": [{"uri": params.get("uri"), "text": json.dumps(plain(engine.resource(params.get("uri", ""))), default=str)}]}
        elif method == "prompts/list":
            result = {"prompts": [{"name": "grounded_note_answer", "arguments": [{"name": "question", "required": True}, {"name": "top_k"}]}]}
        elif method == "prompts/get":
            result = {"messages": [{"role": "user", "content": {"type": "text", "text": engine.prompt(**(params.get("arguments") or {}))}}]}
        else:
            return {"jsonrpc": "2.0", "id": key, "error": {"code": NO_METHOD, "message": f"unknown method: {method}"}}
    except (ToolError, TypeError, ValueError) as e:
        return {"jsonrpc": "2.0", "id": key, "error": {"code": BAD_ARGUMENTS, "message": str(e)}}
    except Exception as e:
        return {"jsonrpc": "2.0", "id": key, "error": {"code": FAILED, "message": str(e)[:500]}}
    return {"jsonrpc": "2.0", "id": key, "result": result}


def serve(engine: Engine, incoming, outgoing) -> None:
    while (message := read_message(incoming)) is not None:
        if answer := handle(engine, message):
            write_message(outgoing, answer)
