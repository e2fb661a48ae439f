"""Error taxonomy of the engine."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors raised by this package."""


class InvalidCommand(EngineError):
    """A query, statement or request that the engine does not accept."""


class InvalidSchema(EngineError):
    """A table specification that breaks a naming or role rule."""


class NotFound(EngineError):
    """No live record, table, snapshot or job under that name."""


class TenantMismatch(EngineError):
    """The actor's tenant is not the tenant that the request names."""


class IdentityMismatch(EngineError):
    """A record's id or tenant column disagrees with its header."""


class DimensionMismatch(EngineError):
    """A vector whose length is not the declared number of dimensions."""


class Corrupt(EngineError):
    """A stored file whose checksum or structure is wrong."""


class Conflict(EngineError):
    """A write against a generation that has moved on, or a reused key with another body."""


class InvalidCursor(EngineError):
    """A page cursor that is malformed, expired, forged or meant for another query."""


class NotPermitted(EngineError):
    """A path or operation outside what the caller may touch."""


class UnknownTable(NotFound):
    """A statement or query that names a table which is not there."""


class ModuleRejected(EngineError):
    """An extension module that breaks a rule of registration."""
