"""A thin JSON service over a catalog: each route runs one statement of a session.

One request at a time per branch is enough here, as Spark runs the work; the
service adds no state of its own. Bodies above ``MOST_BYTES`` are refused unread.
"""

from __future__ import annotations

import hmac
import json
import threading
import time
from collections import Counter
from dataclasses import asdict, is_dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import SparkSession

from loomstone.cursor import Signer
from loomstone.errors import Conflict, EngineError, InvalidCommand, InvalidCursor, NotFound, NotPermitted, TenantMismatch
from loomstone.languages import graphql
from loomstone.languages.commands import Session
from loomstone.model import Actor, TableSpec
from loomstone.sources.catalog import Catalog

MOST_BYTES = 16 << 20
#: Route below ``/v1/`` and the statement of a session that it runs.
ROUTES = {
    "schema/apply": "schema", "records/put": "put", "records/put-batch": "batch", "records/patch": "patch", "insert": "patch", "records/delete": "delete", "records/get": "get", "records/scan": "scan",
    "query": "query", "explain": "explain", "admin/compact": "compact", "admin/checkpoint": "checkpoint", "admin/vacuum": "vacuum", "admin/snapshot": "snapshot", "admin/restore": "restore", "admin/jobs": "jobs_list",
    "jobs/run": "jobs_run",
}
#: Status of an error, by its class; others are 400.
STATUS = {NotFound: 404, Conflict: 409, TenantMismatch: 403, NotPermitted: 403, InvalidCursor: 400}


def plain(value: Any) -> Any:
    """Results as JSON can hold them."""
    if is_dataclass(value):
        return plain(asdict(value))
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


class Service:
    """Requests of many actors against the branches of one catalog."""

    def __init__(self, spark: SparkSession, root: str, token: str | None = None, secret: bytes | None = None):
        self.catalog, self.token, self.secret = Catalog(spark, root), token, secret
        self.counts: Counter[str] = Counter()
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    def _session(self, branch: str, actor: Actor) -> Session:
        database, name = branch.split(":")
        return Session(self.catalog.open(branch), actor, Signer(self.secret, database, name) if self.secret else None)

    def handle(self, method: str, path: str, headers: dict[str, str], body: bytes) -> tuple[int, dict[str, Any]]:
        """Status and JSON of a request. ``X-Tenant``, ``X-User`` and ``X-Branch`` say who asks and where."""
        route = path.split("?")[0].removeprefix("/v1/").strip("/")
        self.counts[route] += 1
        if route in ("health", "ready"):
            return 200, {"ok": True}
        given = headers.get("authorization", "")
        if self.token is not None and not hmac.compare_digest(given.encode(), f"Bearer {self.token}".encode()):
            return 401, {"error": "a token is needed"}
        try:
            payload = json.loads(body) if body.strip() else {}
            return 200, plain(self._run(method, route, headers, payload))
        except EngineError as error:
            status = next((s for kind, s in STATUS.items() if isinstance(error, kind)), 400)
            return status, {"error": str(error), "code": type(error).__name__}
        except (ValueError, KeyError, TypeError, AttributeError) as error:
            return 400, {"error": f"the request cannot be read: {error}", "code": "InvalidCommand"}

    def _run(self, method: str, route: str, headers: dict[str, str], p: dict[str, Any]) -> Any:
        if route == "metrics":
            return {"requests": dict(self.counts)}
        if route == "databases":
            return {"databases": self.catalog.databases()} if method == "GET" else self.catalog.create_database(p["org_id"], p["project_id"], p["name"], p["region"])
        if route == "branches":
            return {"branches": self.catalog.branches()} if method == "GET" else self.catalog.create_branch(p["database_id"], p["name"], p.get("parent"))
        branch = headers.get("x-branch", "db_main:main")
        actor = Actor(headers.get("x-tenant") or p.get("tenant_id", ""), headers.get("x-user", "legacy-query"))
        with self._guard:
            lock = self._locks.setdefault(branch, threading.Lock())
        with lock:
            session = self._session(branch, actor)
            if route in ROUTES:
                if (key := headers.get("idempotency-key")) and "idempotency_key" not in p:
                    p = {**p, "idempotency_key": key}
                return getattr(session, f"_{ROUTES[route]}")(p)
            if route == "statement":
                return session.run(p["text"])
            if route == "graphql":
                return session.execute(p["query"], p.get("variables"))
            if route == "graphql/bounded":
                return session._page(graphql.parse(p["query"]))
            if route == "graphql/schema":
                return {"schema": graphql.schema_text([TableSpec.from_dict(raw) for raw in session.store.manifest()["tables"].values()])}
            job = {"worker_id": "", "now": int(time.time() * 1000), **p}
            if route == "internal/jobs/lease":
                return {"job": session.queue.lease_next(job["worker_id"], job["kind"], job["now"], job.get("lease_ms", 30_000))}
            if route == "internal/jobs/heartbeat":
                return {"job": session.queue.heartbeat(job["job_id"], job["token"], job["now"], job.get("lease_ms", 30_000))}
            if route == "internal/jobs/complete":
                return {"job": session.queue.complete(job["job_id"], job["token"])}
            if route == "internal/jobs/fail":
                return {"job": session.queue.fail(job["job_id"], job["token"], job.get("error", ""), bool(job.get("permanent")), job.get("not_before", 0))}
        raise InvalidCommand(f"no route is called {route!r}")


def server(service: Service, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server of the service, to be started with ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("content-length") or 0)
            if size > MOST_BYTES:
                status, made = 413, {"error": f"a body has at most {MOST_BYTES} bytes"}
            else:
                status, made = service.handle(self.command, self.path, {k.lower(): v for k, v in self.headers.items()}, self.rfile.read(size))
            text = json.dumps(made).encode()
            self.send_response(status)
            self.send_header("content-type", "application/json")
            self.send_header("content-length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        do_GET = do_POST = _answer

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
