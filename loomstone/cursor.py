"""Page cursors: plain offsets and signed tokens bound to one query."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
from dataclasses import asdict, dataclass, replace
from typing import Any

from loomstone.errors import InvalidCursor

PREFIX = "lsc1"
LIFETIME = 3600


def digest(value: Any) -> str:
    """A short stable digest of a JSON value."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:32]


@dataclass(frozen=True)
class Scope:
    """What a cursor belongs to. Any difference makes it invalid."""

    kind: str
    tenant: str
    database: str
    branch: str
    actor: str
    query: str
    limit: int
    order: str


@dataclass(frozen=True)
class State:
    """Where a cursor continues, at which snapshot, until when."""

    scope: Scope
    offset: int
    epoch: int
    expires: int


def _b64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _unb64(text: str) -> bytes:
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True)
    except ValueError as error:
        raise InvalidCursor("cursor is not base64") from error


def encode(state: State, secret: bytes) -> str:
    payload = json.dumps(asdict(state), sort_keys=True, separators=(",", ":")).encode()
    return f"{PREFIX}.{_b64(payload)}.{_b64(hmac.new(secret, payload, hashlib.sha256).digest())}"


def decode(token: str, scope: Scope, secret: bytes, now: float | None = None) -> State:
    """The state of a token that is genuine, in time and made for ``scope``."""
    parts = token.split(".")
    if len(parts) != 3 or parts[0] != PREFIX:
        raise InvalidCursor("cursor has another form")
    payload = _unb64(parts[1])
    if not hmac.compare_digest(hmac.new(secret, payload, hashlib.sha256).digest(), _unb64(parts[2])):
        raise InvalidCursor("cursor signature does not match")
    raw = json.loads(payload)
    state = State(Scope(**raw.pop("scope")), **raw)
    if state.scope != scope:
        wrong = [k for k, v in asdict(scope).items() if getattr(state.scope, k) != v]
        raise InvalidCursor(f"cursor belongs to another {', '.join(wrong)}")
    if state.expires <= (time.time() if now is None else now):
        raise InvalidCursor("cursor has expired")
    return state


def begin(scope: Scope, epoch: int, now: float | None = None, lifetime: int = LIFETIME) -> State:
    return State(scope, 0, epoch, int(time.time() if now is None else now) + lifetime)


def advance(state: State, by: int) -> State:
    return replace(state, offset=state.offset + by)


@dataclass(frozen=True)
class Signer:
    """Signs and opens the cursors of one branch of a database."""

    secret: bytes
    database: str = "main"
    branch: str = "main"
    lifetime: int = LIFETIME

    def scope(self, kind: str, tenant: str, actor: Any, query: str, limit: int, order: str) -> Scope:
        return Scope(kind, tenant, self.database, self.branch, digest(asdict(actor)), query, limit, order)

    def seal(self, state: State) -> str:
        return encode(state, self.secret)

    def open(self, token: str, scope: Scope, now: float | None = None) -> State:
        return decode(token, scope, self.secret, now)
