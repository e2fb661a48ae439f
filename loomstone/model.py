"""Tables, queries, actors and the policy struct."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from enum import StrEnum
from typing import Any

from pyspark.sql import types as T

from loomstone.errors import InvalidCommand, InvalidSchema, TenantMismatch

#: Names that result rows use; a column may not take them.
RESERVED = ("record_id", "version_id", "fields", "score")
_IDENTIFIER = re.compile(r"[_A-Za-z][_0-9A-Za-z]*\Z")


class Freshness(StrEnum):
    """Which derived vectors may be scored. ``LAZY`` executes as ``STRICT``."""

    STRICT = "Strict"
    LAZY = "Lazy"
    ALLOW_DIRTY = "AllowDirty"


@dataclass(frozen=True)
class VectorSpec:
    """A derived vector column and the columns it is computed from."""

    name: str
    dimensions: int
    sources: tuple[str, ...]


@dataclass(frozen=True)
class TableSpec:
    """Column roles of a table. Types are Spark's; roles are declared, never inferred."""

    name: str
    id_column: str = "id"
    tenant_column: str = "tenant"
    scalars: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    vectors: tuple[VectorSpec, ...] = ()

    def validate(self) -> TableSpec:
        """This spec, or ``InvalidSchema`` naming the broken rule."""
        _identifier("table", self.name)
        roles = {
            "id column": [self.id_column], "tenant column": [self.tenant_column], "scalar column": list(self.scalars),
            "text column": list(self.texts), "vector column": [v.name for v in self.vectors],
        }
        owner: dict[str, str] = {}
        for role, names in roles.items():
            for name in names:
                _identifier(role, name)
                if name in RESERVED:
                    raise InvalidSchema(f"{role} {name!r} is reserved")
                if name in owner:
                    raise InvalidSchema(f"{role} {name!r} is already the {owner[name]}")
                owner[name] = role
        declared = {self.id_column, self.tenant_column, *self.scalars, *self.texts}
        for v in self.vectors:
            if v.dimensions <= 0:
                raise InvalidSchema(f"vector column {v.name!r} needs dimensions above 0")
            if not v.sources:
                raise InvalidSchema(f"vector column {v.name!r} needs a source column")
            if len(set(v.sources)) != len(v.sources):
                raise InvalidSchema(f"vector column {v.name!r} repeats a source column")
            if missing := [s for s in v.sources if s not in declared]:
                raise InvalidSchema(f"vector column {v.name!r} has undeclared sources {missing}")
        return self

    def accepts(self, new: TableSpec, has_rows: bool) -> None:
        """Raises unless ``new`` may replace this spec: with visible rows, identity columns and kept dimensions stay."""
        new.validate()
        if not has_rows:
            return
        if (self.id_column, self.tenant_column) != (new.id_column, new.tenant_column):
            raise InvalidSchema("identity columns cannot change while the table has rows")
        kept = {v.name: v.dimensions for v in new.vectors}
        for v in self.vectors:
            if kept.get(v.name, v.dimensions) != v.dimensions:
                raise InvalidSchema(f"vector column {v.name!r} cannot change dimensions while the table has rows")

    def vector(self, name: str | None) -> VectorSpec:
        """The named vector column, or the only one."""
        if name is None and len(self.vectors) == 1:
            return self.vectors[0]
        for v in self.vectors:
            if v.name == name:
                return v
        raise InvalidCommand(f"vector field {name!r} is not a vector column of {self.name}" if name else f"table {self.name} needs a vector field to be named")

    def text_columns(self, name: str | None) -> tuple[str, ...]:
        """The named text column, or all of them."""
        if name is None:
            return self.texts
        if name not in self.texts:
            raise InvalidCommand(f"text field {name!r} is not a text column of {self.name}")
        return (name,)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> TableSpec:
        vectors = tuple(VectorSpec(v["name"], int(v["dimensions"]), tuple(v["sources"])) for v in raw.get("vectors", ()))
        return cls(raw["name"], raw.get("id_column", "id"), raw.get("tenant_column", "tenant"), tuple(raw.get("scalars", ())), tuple(raw.get("texts", ())), vectors)


def _identifier(role: str, name: str) -> None:
    if not isinstance(name, str) or not _IDENTIFIER.match(name):
        raise InvalidSchema(f"{role} {name!r} is not an identifier")
    if name.startswith("__"):
        raise InvalidSchema(f"{role} {name!r} may not begin with two underscores")


@dataclass(frozen=True)
class Actor:
    """Who asks."""

    tenant_id: str
    user_id: str = "legacy-query"

    def for_tenant(self, tenant_id: str) -> Actor:
        """This actor, unless the request names another tenant."""
        if tenant_id != self.tenant_id:
            raise TenantMismatch(f"actor of tenant {self.tenant_id!r} asked for tenant {tenant_id!r}")
        return self


@dataclass(frozen=True)
class HybridQuery:
    """One retrieval: filters, up to four kinds of evidence, and a page."""

    table: str
    tenant_id: str
    text: str | None = None
    text_field: str | None = None
    vector: Sequence[float] | None = None
    vector_field: str | None = None
    scalar_eq: Mapping[str, Any] = field(default_factory=dict)
    graph_seed: str | None = None
    temporal_as_of: int | None = None
    top_k: int = 10
    freshness: Freshness = Freshness.STRICT
    explain: bool = False
    cursor: str | None = None

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> HybridQuery:
        """A query from its JSON form; unknown members are refused."""
        if unknown := set(raw) - set(cls.__dataclass_fields__):
            raise InvalidCommand(f"unknown query members {sorted(unknown)}")
        try:
            return cls(**{**raw, "freshness": Freshness(raw.get("freshness", Freshness.STRICT))})
        except (TypeError, ValueError) as error:
            raise InvalidCommand(f"invalid query: {error}") from error

    @property
    def has_text(self) -> bool:
        return self.text is not None and bool(self.text.strip())

    def budget(self, offset: int) -> int:
        """Candidates that each stream may pass on."""
        return 4 * (offset + self.top_k + 1)


#: A record's policy. Every member but the three optional ones must be there.
POLICY = T.StructType([
    T.StructField("tenant_id", T.StringType()), T.StructField("workspace_id", T.StringType()), T.StructField("owner_id", T.StringType()),
    T.StructField("visibility", T.StringType()),
    T.StructField("acl", T.ArrayType(T.StructType([T.StructField("user_id", T.StringType()), T.StructField("allow", T.BooleanType())]))),
    T.StructField("sensitivity", T.StringType()),
    T.StructField("retention", T.StructType([T.StructField("retain_until_epoch", T.LongType()), T.StructField("legal_hold", T.BooleanType())])),
    T.StructField("suppress_from_ai", T.BooleanType()), T.StructField("allow_embedding", T.BooleanType()), T.StructField("allow_training", T.BooleanType()),
])
VISIBILITIES = ("Tenant", "Public", "Acl", "Hidden")
