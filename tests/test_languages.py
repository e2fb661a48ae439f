"""What the three text forms accept and refuse, and that they agree."""

from __future__ import annotations

import pytest

from loomstone.errors import InvalidCommand, InvalidSchema
from loomstone.languages import graphql, lines
from loomstone.model import Freshness, HybridQuery, TableSpec, VectorSpec

FULL = """
# a comment
FROM plants
TENANT north-garden
WHERE bed = "shade"
MATCH notes "late frost"
NEAR leaf [0.5, -0.25, 2.0]
FRESHNESS lazy
LIMIT 12
EXPLAIN
"""


def test_lines():
    want = HybridQuery("plants", "north-garden", "late frost", "notes", [0.5, -0.25, 2.0], "leaf", {"bed": "shade"}, top_k=12, freshness=Freshness.LAZY, explain=True)
    assert lines.parse(FULL) == want
    assert lines.parse(FULL.replace("FROM", "from").replace("LIMIT", "limit")) == want


def test_values_over_lines():
    q = lines.parse('FROM plants\nTENANT t\nWHERE soil = {\n "kind": "loam",\n "ph": [6, 6.5]\n}\nNEAR leaf [\n3.0,\n-1.5\n]\nMATCH notes "dry\\nsandy"\nLIMIT 4')
    assert q.scalar_eq == {"soil": {"kind": "loam", "ph": [6, 6.5]}} and q.vector == [3.0, -1.5] and q.text == "dry\nsandy" and q.top_k == 4


def test_defaults():
    q = lines.parse('FROM docs\nTENANT t\nMATCH body "x"')
    assert (q.freshness, q.top_k, q.explain) == (Freshness.STRICT, 10, False)


@pytest.mark.parametrize("text,message", [
    ("FROM docs\nTENANT t\nMATCH notes moss(\nLIMIT 3", "never closed"),
    ("FROM docs\nTENANT t\nMATCH notes moss)", "closes nothing"),
    ('FROM docs\nTENANT t\nMATCH notes "moss', "has no end"),
    ("FROM docs\nTENANT t\nERASE docs", "no line begins"),
    ('FROM docs\nTENANT t\nWHERE c = "a"\nWHERE c = "b"', "two WHERE"),
    ("FROM docs\nTENANT t\nFRESHNESS strict\nFRESHNESS lazy", "second FRESHNESS"),
    ("FROM docs\nTENANT t\nLIMIT 2\nLIMIT 3", "second LIMIT"),
    ("FROM docs\nTENANT t\nEXPLAIN\nEXPLAIN", "second EXPLAIN"),
    ("FROM docs\nFROM docs\nTENANT t", "second FROM"),
    ('FROM docs\nMATCH body "x"', "TENANT"),
    ("TENANT t", "FROM"),
    ("FROM docs\nTENANT t\nLIMIT 0", "begins at 1"),
    ("FROM docs\nTENANT t\nLIMIT x", "whole number"),
    ("FROM docs\nTENANT t\nFRESHNESS soon", "one of strict"),
    ("FROM docs\nTENANT t\nNEAR e []", "no numbers"),
    ("FROM docs\nTENANT t\nNEAR e [1, \"x\"]", "numbers in brackets"),
    ("FROM docs\nTENANT t\nEXPLAIN now", "nothing may follow"),
    ("FROM docs\nTENANT t\nWHERE c", "equals sign"),
])
def test_lines_refuse(text, message):
    with pytest.raises(InvalidCommand, match=message.replace("(", r"\(")):
        lines.parse(text)


def test_select():
    q = lines.parse('EXPLAIN SELECT * FROM plants\nWHERE tenant_id = "north-garden" AND bed = \'gardener\'\'s own\' AND rows = 4 AND ph = 6.5 AND wet = true LIMIT 7;')
    assert q == HybridQuery("plants", "north-garden", scalar_eq={"bed": "gardener's own", "rows": 4, "ph": 6.5, "wet": True}, top_k=7, explain=True)
    assert lines.parse("select * from docs where tenant = t").tenant_id == "t"


@pytest.mark.parametrize("text,message", [
    ('SELECT * FROM docs WHERE tenant_id = "t" AND c = "a" AND c = "b"', "two conditions"),
    ('SELECT * FROM plants JOIN beds ON plants.bed = beds.id WHERE tenant_id = "t"', "JOIN has no place"),
    ('SELECT * FROM docs WHERE tenant_id = "t" OR wet = "p"', "OR"),
    ('SELECT id FROM docs WHERE tenant_id = "t"', r"SELECT \*"),
    ('SELECT * FROM docs WHERE tenant_id = "t" LIMIT 0', "from 1 on"),
    ('SELECT * FROM docs WHERE tenant_id = "t" ORDER BY x', "ORDER"),
    ("SELECT * FROM docs", "tenant_id"),
    ('SELECT * FROM docs WHERE tenant_id = "t" LIMIT 3 weeds', "weeds"),
    ('SELECT * FROM docs WHERE tenant_id > "t"', "expected"),
])
def test_select_refuses(text, message):
    with pytest.raises(InvalidCommand, match=message):
        lines.parse(text)


GRAPH = """query Beds {
  # a comment with braces } and ( in it
  plants(tenant_id: "north-garden", where: { bed: "shade" }, match_field: "notes", match: "late frost", near_field: "leaf",
       near: [0.5, -0.25, 2.0], limit: 12, freshness: LAZY, explain: true) { record_id fields score { final_score } }
}"""


def test_forms_agree():
    assert graphql.parse(GRAPH) == lines.parse(FULL)
    assert graphql.parse('{ docs(tenant: "t", filter: {c: 1}, limit: 3) { record_id } }') == lines.parse("SELECT * FROM docs WHERE tenant_id = 't' AND c = 1 LIMIT 3") == lines.parse("FROM docs\nTENANT t\nWHERE c = 1\nLIMIT 3")


@pytest.mark.parametrize("text", [
    "query { plants(tenant_id: north, match: Y) { record_id } }", 'query { docs(tenant_id: bare) { record_id } }', 'mutation { plant(bed: "shade") { record_id } }',
    'query { alias: docs(tenant_id: "t") { record_id } }', 'query { docs(tenant_id: "t") { ...F } }', 'query { docs(tenant_id: "t", tenant: "u") { record_id } }',
    'query ($t: String) { docs(tenant_id: $t) { record_id } }', 'query { docs(tenant_id: "t") @include(if: true) { record_id } }', "{ __schema { types } }",
    'query { docs(tenant_id: "t") { record_id } other(tenant_id: "t") { record_id } }', 'query { docs(tenant_id: "t", limit: 0) { record_id } }', 'query { docs(tenant_id: "t", nope: 1) { record_id } }',
    'query { docs(tenant_id: "t") }', 'query { docs(tenant_id: "t") { } }', 'query { docs(match: "x") { record_id } }', 'query { docs(tenant_id: "t") { record_id }', 'query { docs(tenant_id: "t", near: ["x"]) { record_id } }',
])
def test_graphql_refuses(text):
    with pytest.raises(InvalidCommand, match="GraphQL cannot be read"):
        graphql.parse(text)


SPEC = TableSpec("docs", "id", "tenant", ("category",), ("body",), (VectorSpec("embedding", 3, ("body",)),))


def test_schema_text():
    text = graphql.schema_text([SPEC])
    for piece in ("scalar LoomJSON", "enum LoomFreshness", "type LoomScore", "type Query", "docs(", "tenant_id: ID!", "where: DocsWhere", "match_field: String", "near_field: String", "type DocsRow", "record_id: ID!", "category: LoomJSON", "body: String", "embedding: [Float!]"):
        assert piece in text
    assert text == graphql.schema_text([SPEC])


def test_json_form():
    assert HybridQuery.from_dict({"table": "d", "tenant_id": "t", "freshness": "AllowDirty"}).freshness == Freshness.ALLOW_DIRTY
    for bad in ({"table": "d"}, {"table": "d", "tenant_id": "t", "nope": 1}, {"table": "d", "tenant_id": "t", "freshness": "Soon"}):
        with pytest.raises(InvalidCommand):
            HybridQuery.from_dict(bad)


@pytest.mark.parametrize("spec", [
    TableSpec("1docs"), TableSpec("docs", "__id"), TableSpec("docs", "id", "id"), TableSpec("docs", scalars=("a", "a")), TableSpec("docs", scalars=("a",), texts=("a",)), TableSpec("docs", scalars=("score",)),
    TableSpec("docs", texts=("b",), vectors=(VectorSpec("v", 0, ("b",)),)), TableSpec("docs", texts=("b",), vectors=(VectorSpec("v", 3, ()),)), TableSpec("docs", vectors=(VectorSpec("v", 3, ("b",)),)),
    TableSpec("docs", texts=("b",), vectors=(VectorSpec("v", 3, ("b", "b")),)), TableSpec("docs", scalars=(" a",)),
])
def test_specs_refused(spec):
    with pytest.raises(InvalidSchema):
        spec.validate()


def test_evolution():
    wider = TableSpec("docs", "id", "tenant", ("category",), ("body",), (VectorSpec("embedding", 4, ("body",)),))
    SPEC.accepts(wider, has_rows=False)
    with pytest.raises(InvalidSchema):
        SPEC.accepts(wider, has_rows=True)
    SPEC.accepts(TableSpec("docs", "id", "tenant", ("category", "x"), ("body",)), has_rows=True)
    with pytest.raises(InvalidSchema):
        SPEC.accepts(TableSpec("docs", "key", "tenant"), has_rows=True)
    assert TableSpec.from_dict(SPEC.to_dict()) == SPEC


def test_operations():
    assert graphql.operation('mutation { put(input: "{\\"id\\": 1}") { epoch } }', {}) == ("put", {"id": 1})
    assert graphql.operation("query Q($x: JSON!) { get(input: $x) { record } }", {"x": {"id": "a"}}) == ("get", {"id": "a"})
    assert graphql.operation('{ scan(input: {table: "plants", limit: 3}) }', {}) == ("scan", {"table": "plants", "limit": 3}) and graphql.operation("{ jobs }", {}) == ("jobs", {})
    for bad in ("{ put(input: $x) }", '{ put(input: "{") }', "{ put(other: 1) }", "{ put get }", "{ put(input: 3) }", "query ($x: Int { get(input: $x) }"):
        with pytest.raises(InvalidCommand):
            graphql.operation(bad, {})
