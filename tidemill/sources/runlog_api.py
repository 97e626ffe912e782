"""Run logs over HTTP: a WSGI application that lists them and gives what was appended since an offset, and a page that shows them.

    from wsgiref.simple_server import make_server
    make_server("127.0.0.1", 8000, runlog_api.application("/runs")).serve_forever()
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from pathlib import Path
from urllib.parse import parse_qs

LOG_NAME = "run.jsonl"
JSON, LINES, HTML = "application/json", "application/x-ndjson", "text/html; charset=utf-8"
Answer = tuple[int, str, bytes]
_SAID = {200: "OK", 400: "Bad Request", 404: "Not Found"}

PAGE = """<!doctype html><meta charset="utf-8"><title>Runs</title><table id="t"></table><script>
const seen = {};
async function look() {
  for (const run of (await (await fetch("api/runs")).json()).runs) {
    const own = seen[run.path] ??= {at: 0, steps: {}};
    if (run.size < own.at) seen[run.path] = {at: 0, steps: {}};  // the log was begun again
    const now = seen[run.path], text = await (await fetch(`api/run?offset=${now.at}&path=${encodeURIComponent(run.path)}`)).text();
    const whole = text.slice(0, text.lastIndexOf("\\n") + 1);
    now.at += new TextEncoder().encode(whole).length;
    for (const line of whole.split("\\n")) { try { const p = JSON.parse(line); now.steps[p.step] = p; now.last = p; } catch {} }
  }
  const table = document.getElementById("t");
  table.replaceChildren(...Object.entries(seen).map(([path, run]) => {
    const row = document.createElement("tr");
    for (const x of [path, Object.keys(run.steps).length, run.last?.step, run.last?.train_loss, run.last?.val_loss]) row.insertCell().textContent = x ?? "-";
    return row;
  }));
}
look(); setInterval(look, 3000);
</script>"""


def _said(code: int, value: object) -> Answer:
    return code, JSON, json.dumps(value).encode()


def listed(root: Path) -> list[dict]:
    """Logs below the root, the newest first, equal times by path."""
    found = [(p, p.stat()) for p in root.rglob(LOG_NAME) if p.is_file()]
    return [{"path": p.relative_to(root).as_posix(), "size": s.st_size, "mtime": s.st_mtime} for p, s in sorted(found, key=lambda x: (-x[1].st_mtime, x[0].as_posix()))]


def inside(root: Path, name: str) -> Path | None:
    """A file below the root, links followed; None for anything else."""
    try:
        path = (root / name).resolve()
    except (OSError, ValueError):
        return None
    return path if path.is_file() and path.is_relative_to(root.resolve()) else None


def appended(root: Path, query: dict[str, list[str]]) -> Answer:
    """A log's bytes from an offset on."""
    name, offset = query.get("path", [""])[0], query.get("offset", ["0"])[0]
    if not name:
        return _said(400, {"error": "missing path"})
    if not offset.isascii() or not offset.isdecimal():
        return _said(400, {"error": "invalid offset"})
    path = inside(root, name)
    if path is None:
        return _said(404, {"error": "not found"})
    with path.open("rb") as log:
        log.seek(int(offset))
        return 200, LINES, log.read()


def application(root: str) -> Callable[[dict, Callable], Iterable[bytes]]:
    at = Path(root)
    routes: dict[str, Callable[[dict[str, list[str]]], Answer]] = {
        "/": lambda _: (200, HTML, PAGE.encode()),
        "/api/runs": lambda _: _said(200, {"root": at.as_posix(), "runs": listed(at)}),
        "/api/run": lambda query: appended(at, query),
    }

    def app(environ: dict, start_response: Callable) -> Iterable[bytes]:
        route = routes.get(environ.get("PATH_INFO") or "/", lambda _: _said(404, {"error": "not found"}))
        code, kind, body = route(parse_qs(environ.get("QUERY_STRING", "")))
        start_response(f"{code} {_SAID[code]}", [("Content-Type", kind), ("Content-Length", str(len(body))), ("Cache-Control", "no-store")])
        return [body]

    return app
