"""Command statements with a JSON payload, over one store.

``SCHEMA APPLY``, ``[RECORD] PUT | BATCH | PATCH | DELETE | GET | SCAN``,
``QUERY``, ``EXPLAIN``, ``[ADMIN] COMPACT | CHECKPOINT | VACUUM | SNAPSHOT |
RESTORE``, ``JOBS LIST | RUN``. Anything else is a query in the line language or the SELECT form.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict
from typing import Any

from pyspark.sql import functions as F

from loomstone.cursor import Signer
from loomstone.errors import DimensionMismatch, EngineError, IdentityMismatch, InvalidCommand, NotFound
from loomstone.functions.predicates import canonical
from loomstone.languages import graphql, lines
from loomstone.model import Actor, HybridQuery, TableSpec
from loomstone.plans.hybrid import Table
from loomstone.sources.jobs import Queue
from loomstone.sources.storage import Store
from loomstone.sources.tables import columns_of, open_table, spec_of

PREFIXES = ("RECORD", "ADMIN")
COMMANDS = ("PUT", "BATCH", "PATCH", "DELETE", "GET", "SCAN", "QUERY", "EXPLAIN", "COMPACT", "CHECKPOINT", "VACUUM", "SNAPSHOT", "RESTORE")


def split(statement: str) -> tuple[str, dict[str, Any]] | None:
    """Command and payload of a statement, or nothing if it is a query."""
    words = statement.strip().split(None, 2)
    if not words:
        raise InvalidCommand("empty statement")
    first = words[0].upper()
    if [w.upper() for w in words[:2]] == ["SCHEMA", "APPLY"]:
        name, body = "SCHEMA", " ".join(words[2:])
    elif first == "JOBS" and len(words) > 1 and words[1].upper() in ("LIST", "RUN"):
        name, body = f"JOBS_{words[1].upper()}", " ".join(words[2:])
    elif first in PREFIXES and len(words) > 1 and words[1].upper() in COMMANDS:
        name, body = words[1].upper(), " ".join(words[2:])
    elif first in COMMANDS and (len(words) == 1 or words[1].startswith("{")):
        name, body = first, statement.strip()[len(words[0]) :]
    else:
        return None
    try:
        payload = json.loads(body) if body.strip() else {}
    except ValueError as error:
        raise InvalidCommand(f"{name} payload is not JSON: {error}") from error
    if not isinstance(payload, dict):
        raise InvalidCommand(f"{name} payload must be an object")
    return name, payload


class Session:
    """Runs statements as one actor."""

    def __init__(self, store: Store, actor: Actor, signer: Signer | None = None):
        self.store, self.actor, self.signer, self.queue = store, actor, signer, Queue(store)

    def _table(self, name: str) -> Table:
        return open_table(self.store, name, None, self.signer)

    def execute(self, text: str, variables: Mapping[str, Any] | None = None) -> dict[str, Any]:
        """One GraphQL operation whose root field is a statement: ``{ put(input: "...") }``, or with ``input: $name``.

        The result is ``{"data": {field: value}}``, or null data and the errors.
        """
        try:
            field, payload = graphql.operation(text, variables or {})
            if field not in FIELDS:
                raise InvalidCommand(f"no operation is called {field!r}")
            return {"data": {field: getattr(self, f"_{FIELDS[field]}")(payload)}}
        except (EngineError, KeyError, TypeError) as error:
            return {"data": None, "errors": [{"message": f"{type(error).__name__}: {error}"}]}

    def run(self, statement: str) -> Any:
        found = split(statement)
        if found is None:
            return self._page(lines.parse(statement))
        name, payload = found
        return getattr(self, f"_{name.lower()}")(payload)

    def _page(self, query: HybridQuery) -> dict[str, Any]:
        page = self._table(query.table).query(query, self.actor)
        rows = [{"record_id": r.record_id, "version_id": r.version_id, "score": {k: r[k] for k in ("vector", "lexical", "relational", "freshness_penalty", "final_score")}} for r in page.rows]
        return {"results": rows, "next_cursor": page.next_cursor, "explain": page.explain}

    def _rows(self, records: list[Mapping[str, Any]], op: str, key: str | None) -> int:
        """Commits records given as ``table, tenant_id, id, fields`` after checking identity and dimensions."""
        out = []
        for i, r in enumerate(records):
            if missing := {"table", "tenant_id", "id"} - set(r):
                raise InvalidCommand(f"record lacks {sorted(missing)}")
            self.actor.for_tenant(r["tenant_id"])
            spec = spec_of(self.store, r["table"])
            fields = dict(r.get("fields", {}))
            for column, header in ((spec.id_column, r["id"]), (spec.tenant_column, r["tenant_id"])):
                if not isinstance(header, str) or not header or fields.get(column, header) != header:
                    raise IdentityMismatch(f"{column} disagrees with the record's header")
            for v in spec.vectors:
                given = fields.get(v.name)
                if given is not None and (not isinstance(given, list) or len(given) != v.dimensions):
                    raise DimensionMismatch(f"vector {v.name!r} has {v.dimensions} dimensions")
            out.append((r["table"], r["tenant_id"], r["id"], i, op, {k: None if x is None else canonical(x) for k, x in fields.items()}))
        batch = self.store.spark.createDataFrame(out, "table string, tenant_id string, record_id string, ordinal long, op string, fields map<string,string>")
        return self.store.append(batch, key)

    def _schema(self, p: dict[str, Any]) -> dict[str, Any]:
        self.store.apply_schema(TableSpec.from_dict(p))
        return {"table": p["name"]}

    def _put(self, p: dict[str, Any]) -> dict[str, Any]:
        return {"epoch": self._rows([p], "put", p.get("idempotency_key"))}

    def _batch(self, p: dict[str, Any]) -> dict[str, Any]:
        return {"epoch": self._rows(p.get("records", []), "put", p.get("idempotency_key"))}

    def _patch(self, p: dict[str, Any]) -> dict[str, Any]:
        return {"epoch": self._rows([p], "patch", p.get("idempotency_key"))}

    def _live(self, p: dict[str, Any]) -> dict[str, Any]:
        spec = spec_of(self.store, p["table"])
        self.actor.for_tenant(p["tenant_id"])
        columns = columns_of(spec)
        row = self.store.state(p["table"], columns).where((F.col("tenant_id") == p["tenant_id"]) & (F.col("record_id") == p["id"])).first()
        if row is None:
            raise NotFound(f"no record {p['id']!r}")
        return {"record_id": row.record_id, "version_id": row.version_id, "fields": {c: json.loads(row[c]) for c in columns if row[c] is not None and not c.startswith("__")}}

    def _delete(self, p: dict[str, Any]) -> dict[str, Any]:
        self._live(p)
        return {"epoch": self._rows([{**p, "fields": {}}], "delete", p.get("idempotency_key"))}

    def _get(self, p: dict[str, Any]) -> dict[str, Any]:
        return self._live(p)

    def _scan(self, p: dict[str, Any]) -> dict[str, Any]:
        table = self._table(p["table"])
        rows = table.scan(p["tenant_id"], p.get("limit", 100), p.get("cursor"), self.actor).select("record_id", "next_cursor").collect()
        return {"records": [r.record_id for r in rows], "next_cursor": rows[0].next_cursor if rows else None}

    def _query(self, p: dict[str, Any]) -> dict[str, Any]:
        return self._page(HybridQuery.from_dict(p))

    def _explain(self, p: dict[str, Any]) -> dict[str, Any]:
        return self._page(HybridQuery.from_dict({**p, "explain": True}))

    def _compact(self, p: dict[str, Any]) -> dict[str, Any]:
        return {"segment": self.store.compact(p["table"], columns_of(spec_of(self.store, p["table"])))}

    def _checkpoint(self, p: dict[str, Any]) -> dict[str, Any]:
        return {"epoch": self.store.checkpoint(bool(p.get("drop_commits", False)))}

    def _vacuum(self, p: dict[str, Any]) -> dict[str, Any]:
        return {"deleted": self.store.vacuum()}

    def _snapshot(self, p: dict[str, Any]) -> dict[str, Any]:
        return {"path": self.store.snapshot(p["name"])}

    def _restore(self, p: dict[str, Any]) -> dict[str, Any]:
        self.store.restore(p["name"])
        return {"epoch": self.store.manifest()["epoch"]}

    def _jobs_list(self, p: dict[str, Any]) -> dict[str, Any]:
        return {"jobs": self.queue.jobs()}

    def _jobs_run(self, p: dict[str, Any]) -> dict[str, Any]:
        """Enqueues a job; a worker leases it. Without a kind it verifies the database."""
        target = p.get("target", "statement")
        return {"job": asdict(self.queue.enqueue(p.get("kind", "VerifyDatabase"), target, p.get("idempotency_key", target)))}


#: GraphQL root fields and the statements that they run.
FIELDS = {
    "schemaApply": "schema", "applySchema": "schema", "put": "put", "batch": "batch", "patch": "patch", "delete": "delete", "get": "get", "scan": "scan", "query": "query", "explain": "explain",
    "compact": "compact", "snapshot": "snapshot", "restore": "restore", "jobs": "jobs_list", "jobRun": "jobs_run", "runJob": "jobs_run",
}
