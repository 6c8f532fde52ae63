"""A small HTTP workbench over a service: run, explain and look at the evidence, on loopback by default.

``POST /run`` and ``POST /explain`` take ``{"pipeline": PATH, "roles": [...], "head": N}``.  A
pipeline file is Python and is executed, so only files below the folder the
workbench was opened on are taken, and only from this machine unless it is
bound elsewhere on purpose.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from threading import Lock

from tarnwell.errors import TarnwellError
from tarnwell.governance import audit
from tarnwell.governance.policy import Subject
from tarnwell.plans.nodes import load_pipeline
from tarnwell.service import Service

#: Rows that an answer shows at most, and bytes that a request may have.
MOST_ROWS, MOST_BYTES = 1000, 1 << 20
PAGE = """<!doctype html><meta charset="utf-8"><title>tarnwell</title><h1>tarnwell</h1>
<p><input id="p" size="60" placeholder="pipeline.py"> <button onclick="go('run')">run</button> <button onclick="go('explain')">explain</button></p><pre id="o"></pre>
<script>async function go(what){const r=await fetch('/'+what,{method:'POST',headers:{'Content-Type':'application/json'},body:JSON.stringify({pipeline:document.getElementById('p').value})});
document.getElementById('o').textContent=JSON.stringify(await r.json(),null,1)}</script>"""


class Workbench(ThreadingHTTPServer):
    daemon_threads = True

    def __init__(self, service: Service, folder: str, host: str = "127.0.0.1", port: int = 0):
        self.service, self.folder, self.one_run = service, Path(folder).resolve(), Lock()
        super().__init__((host, port), _Handler)

    def pipeline(self, name: str):
        path = (self.folder / name).resolve()
        if not path.is_relative_to(self.folder) or path.suffix != ".py":
            raise ValueError(f"{name!r} is no pipeline file below {self.folder}")
        return load_pipeline(str(path))

    def answer(self, what: str, asked: dict) -> dict:
        subject = Subject(str(asked.get("user") or "workbench"), tuple(map(str, asked.get("roles") or ())))
        plan = self.pipeline(str(asked.get("pipeline") or ""))
        with self.one_run:  # one record at a time
            if what == "explain":
                return {"plan": self.service.explain(plan, subject)}
            head = max(0, min(int(asked.get("head", 20)), MOST_ROWS))
            with self.service.run(plan, subject) as result:
                rows = [r.asDict(recursive=True) for r in result.df.limit(head).collect()]
            return {"columns": result.schema.names, "rows": rows, "events": [e["event"] for e in result.events], "restriction": audit.restriction(result.events)}


class _Handler(BaseHTTPRequestHandler):
    server: Workbench

    def do_GET(self):  # noqa: N802
        if self.path == "/":
            return self._say(200, PAGE.encode(), "text/html; charset=utf-8")
        if self.path == "/health":
            return self._json(200, {"status": "ok", "verified": audit.verify(self.server.service.recorder.entries)})
        if self.path == "/evidence":
            # what was hidden stays hidden here: no counts of rows
            return self._json(200, {"entries": audit.view(self.server.service.recorder.entries, {"details", "others"})})
        return self._json(404, {"error": "not found"})

    def do_POST(self):  # noqa: N802
        what = self.path.strip("/")
        if what not in ("run", "explain"):
            return self._json(404, {"error": "not found"})
        # a form of another site can't send this type
        if self.headers.get_content_type() != "application/json":
            return self._json(415, {"error": "send application/json"})
        try:
            n = int(self.headers.get("Content-Length") or 0)
            if n > MOST_BYTES:
                return self._json(413, {"error": "too long"})
            return self._json(200, self.server.answer(what, json.loads(self.rfile.read(n) or b"{}")))
        except (TarnwellError, OSError, ValueError, TypeError) as e:
            return self._json(400, {"error": f"{getattr(e, 'kind', type(e).__name__)}: {e}"})

    def _json(self, status: int, body: dict) -> None:
        self._say(status, json.dumps(body, default=str).encode(), "application/json")

    def _say(self, status: int, body: bytes, kind: str) -> None:
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass
