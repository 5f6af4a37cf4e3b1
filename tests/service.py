"""A stand-in for the record service, on this machine: it counts, keeps histories, gives pages, and can fail."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse


class Service:
    """text(name) is a record; a query finds the names stem0, stem1, ... or the one name stem, where it is one."""

    def __init__(self, text, n: int, stem: str = "R"):
        self.asked, self.fails, service = [], set(), self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                start = int(q.get("retstart", -1))
                service.asked.append(q.get("id") or start)
                if start in service.fails:
                    self.send_error(500)
                    return
                if "esearch" in self.path:
                    body = json.dumps({"esearchresult": {"count": str(n), "querykey": "1", "webenv": "w"}})
                else:
                    names = q["id"].split(",") if "id" in q else [stem if n == 1 else f"{stem}{i}" for i in range(start, min(n, start + int(q["retmax"])))]
                    body = "".join(text(x) for x in names)
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_port}/"

    def stop(self) -> None:
        self.server.shutdown()
