"""Ranking, visibility and pages of the hybrid query on small hand-made tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomstone.cursor import Signer
from loomstone.errors import DimensionMismatch, InvalidCommand, InvalidCursor, TenantMismatch
from loomstone.model import Actor, Freshness, HybridQuery, TableSpec, VectorSpec
from loomstone.plans.hybrid import Table, strategy

SPEC = TableSpec("docs", "id", "tenant", ("category",), ("body",), (VectorSpec("embedding", 3, ("body",)),))
SCHEMA = (
    "record_id string, tenant_id string, category string, body string, embedding array<float>, status string, policy_json string, edges array<string>, valid_from long, valid_to long"
)


def make(spark, rows, spec=SPEC):
    """Rows given as (id, tenant, body, vector, extra) with extra overriding columns."""
    full = []
    for record_id, tenant, body, vector, *extra in rows:
        row = {"record_id": record_id, "tenant_id": tenant, "category": None, "body": body, "embedding": vector and [float(x) for x in vector], "status": "Ready" if vector else "Missing", "policy_json": None, "edges": None, "valid_from": None, "valid_to": None}
        row.update(extra[0] if extra else {})
        full.append(tuple(row.values()))
    from loomstone.functions.policy import parsed

    df = spark.createDataFrame(full, SCHEMA)
    df = df.select(
        "*", F.lit(1).cast("long").alias("version_id"), F.lit(1).cast("long").alias("begin_epoch"), F.lit(None).cast("long").alias("end_epoch"), F.lit(None).cast("string").alias("tombstone"),
        F.create_map(F.lit("embedding"), F.col("status")).alias("feature_status"), parsed(F.col("policy_json"), F.col("tenant_id")).alias("policy"),
    )
    return Table(df, spec)


SEED = [("fern", "north", "damp shade under oak", [0.0, 3.0, 0.0]), ("ivy", "north", "climbs the east wall", [0.0, 2.0, 0.5]), ("sage", "south", "damp corner, dry summer", [0.0, 1.0, 0.0])]


def ask(**kw):
    return HybridQuery("docs", kw.pop("tenant_id", "north"), **kw)


def ids(page):
    return [r.record_id for r in page.rows]


def test_other_tenants_never_become_candidates(spark):
    t = make(spark, SEED)
    page = t.query(ask(text="damp oak", vector=[0, 1.0, 0], top_k=5, explain=True))
    assert sorted(ids(page)) == ["fern", "ivy"]
    assert page.explain.tenant_visible == 2 and page.explain.candidates["vector"] == 2
    assert page.explain.strategy == "PolicyPartitionFirst" and page.explain.removed == 0


def test_rare_symbols_find_their_document(spark):
    bodies = ["seed_lot_77", "BED-31 north", "rose::climber::pink", "beds/plan.txt:9", "moss fern", "ivy oak", "w-frost-date"]
    t = make(spark, [(str(i), "t", x, None) for i, x in enumerate(bodies)])
    for text, want in (("seed_lot_77", "0"), ("BED-31", "1"), ("rose::climber", "2"), ("plan.txt:9", "3"), ("frost-date", "6")):
        assert ids(t.query(ask(tenant_id="t", text=text, top_k=3)))[0] == want
    page = t.query(ask(tenant_id="t", text=" -- ..;_", top_k=3))
    assert all(r.lexical is None for r in page.rows)


def test_vector_order(spark):
    t = make(spark, [("wide", "t", "x", [0.3, 0.7, 0.0]), ("tight", "t", "x", [5.0, 0.1, 0.0]), ("square", "t", "x", [0.0, 0.0, 4.0])])
    assert ids(t.query(ask(tenant_id="t", vector=[1.0, 0, 0], top_k=3))) == ["tight", "wide", "square"]


def test_zero_vectors_have_no_score(spark):
    t = make(spark, [("z", "t", "x", [0.0, 0.0, 0.0]), ("y", "t", "x", [1.0, 0.0, 0.0])])
    page = t.query(ask(tenant_id="t", vector=[1.0, 0, 0], top_k=3))
    assert ids(page) == ["y", "z"] and page.rows[1].vector is None and page.rows[1].relational == 1.0


def test_tied_text_falls_to_vector_order(spark):
    rows = [(n, "t", "one and the same", v) for n, v in (("p", [0.0, 0, 2]), ("q", [0.7, 0.3, 0]), ("r", [3.0, 0, 0]), ("s", [0.2, 0.9, 0]), ("u", [0.9, 0.1, 0]))]
    assert ids(make(spark, rows).query(ask(tenant_id="t", text="same", vector=[1.0, 0, 0], top_k=3))) == ["r", "u", "q"]


def test_lexical_hit_wins_over_many_vectors(spark):
    rows = [(f"weed{i:02}", "t", f"weed of row {i}", [1.0, 0.0, 0.002 * i]) for i in range(30)] + [("rare", "t", "orchid_9 found", [0.0, 1.0, 0.0]), ("common", "t", "orchid and orchid", None)]
    page = make(spark, rows).query(ask(tenant_id="t", text="orchid_9", vector=[1.0, 0, 0], top_k=5))
    assert page.rows[0].record_id == "rare" and page.rows[0].lexical > page.rows[1].lexical


def test_without_evidence_rows_come_by_id(spark):
    page = make(spark, SEED).query(ask(top_k=5))
    assert ids(page) == ["fern", "ivy"] and all(r.relational == 1.0 for r in page.rows)
    assert page.rows[0].final_score == pytest.approx(3 / 61)


def test_fallback_outranks_vector_only_evidence(spark):
    rows = [("a", "t", "rain rain", None), ("b", "t", "rain", None), ("m", "t", "none", None), ("z", "t", "none", [1.0, 0, 0])]
    page = make(spark, rows).query(ask(tenant_id="t", text="rain", vector=[1.0, 0, 0], top_k=4))
    assert ids(page) == ["a", "b", "m", "z"]
    assert page.rows[2].final_score > page.rows[3].final_score


@pytest.mark.parametrize("status,mode,scored", [("Dirty", Freshness.STRICT, False), ("Dirty", Freshness.LAZY, False), ("Dirty", Freshness.ALLOW_DIRTY, True), ("Pending", Freshness.ALLOW_DIRTY, False), ("Failed", Freshness.STRICT, False)])
def test_freshness(spark, status, mode, scored):
    t = make(spark, [("a", "t", "peat", [1.0, 0, 0], {"status": status})])
    row = t.query(ask(tenant_id="t", vector=[1.0, 0, 0], freshness=mode)).rows[0]
    assert (row.vector is not None) == scored
    if scored:
        assert row.vector == pytest.approx(0.95) and row.final_score == pytest.approx(1 / 61 - 0.05)


def test_policy(spark):
    policy = '{"tenant_id":"t","visibility":"%s","acl":%s,"sensitivity":"normal","retention":{"legal_hold":false},"suppress_from_ai":%s,"allow_embedding":true,"allow_training":false}'
    acl = '[{"user_id":"keeper","allow":true},{"user_id":"guest","allow":false}]'
    rows = [
        ("hidden", "t", "compost", None, {"policy_json": policy % ("Hidden", "[]", "false")}), ("acl", "t", "compost", None, {"policy_json": policy % ("Acl", acl, "false")}),
        ("public", "t", "compost", None, {"policy_json": policy % ("Public", "[]", "false")}), ("quiet", "t", "compost", None, {"policy_json": policy % ("Tenant", "[]", "true")}),
        ("broken", "t", "compost", None, {"policy_json": '{"visibility":"Hidden"'}), ("plain", "t", "compost", None), ("foreign", "t", "compost", None, {"policy_json": (policy % ("Public", "[]", "false")).replace('"t"', '"u"')}),
    ]
    t = make(spark, rows)
    assert sorted(ids(t.query(ask(tenant_id="t", text="compost"), Actor("t", "keeper")))) == ["acl", "broken", "plain", "public"]
    assert sorted(ids(t.query(ask(tenant_id="t", text="compost"), Actor("t", "guest")))) == ["broken", "plain", "public"]
    assert t.get("t", "hidden").count() == 1
    with pytest.raises(TenantMismatch):
        t.query(ask(tenant_id="t"), Actor("u"))


def test_graph_and_time_are_evidence_not_filters(spark):
    t = make(spark, [("sown", "t", "", None, {"edges": ["bed-2", "bed-4"], "valid_from": 3, "valid_to": 9}), ("wilted", "t", "", None, {"edges": [], "valid_from": 12, "valid_to": 19})])
    page = t.query(ask(tenant_id="t", graph_seed="bed-4", temporal_as_of=7, explain=True))
    assert ids(page) == ["sown", "wilted"]
    assert page.explain.candidates["graph"] == page.explain.candidates["temporal"] == 1
    assert page.rows[0].relational == 0.65 and page.rows[1].relational == 1.0


def test_open_ranges(spark):
    t = make(spark, [("a", "t", "", None), ("b", "t", "", None, {"valid_from": 5})])
    assert t.query(ask(tenant_id="t", temporal_as_of=3, explain=True)).explain.candidates["temporal"] == 1


def test_pages(spark):
    t = make(spark, [(x, "t", "same", None) for x in "abc"])
    first = t.query(ask(tenant_id="t", text="same", top_k=2))
    assert ids(first) == ["a", "b"] and first.next_cursor == "2"
    last = t.query(ask(tenant_id="t", text="same", top_k=2, cursor="2"))
    assert ids(last) == ["c"] and last.next_cursor is None
    rows = t.scan("t", 2).collect()
    assert [r.record_id for r in rows] == ["a", "b"] and rows[0].next_cursor == "2"
    assert [(r.record_id, r.next_cursor) for r in t.scan("t", 2, "2").collect()] == [("c", None)]
    with pytest.raises(InvalidCursor):
        t.scan("t", 2, "x")
    assert t.query(ask(tenant_id="t", top_k=0)).rows == []


def test_two_pages_are_one_long_page(spark):
    t = make(spark, [(f"{i:02}", "t", "word " * (i % 5 + 1) + f"u{i}", [1.0, i / 10, 0.0]) for i in range(20)])
    both = t.query(ask(tenant_id="t", text="word", vector=[1.0, 0, 0], top_k=10))
    one = t.query(ask(tenant_id="t", text="word", vector=[1.0, 0, 0], top_k=5))
    two = t.query(ask(tenant_id="t", text="word", vector=[1.0, 0, 0], top_k=5, cursor=one.next_cursor))
    assert ids(one) + ids(two) == ids(both)


def test_field_checks(spark):
    t = make(spark, SEED)
    for bad in (dict(text="x", text_field="nope"), dict(vector=[1.0, 0, 0], vector_field="nope"), dict(scalar_eq={"body": "x"})):
        with pytest.raises(InvalidCommand):
            t.query(ask(**bad))
    with pytest.raises(DimensionMismatch):
        t.query(ask(vector=[1.0]))


def test_statistics_follow_the_filter(spark):
    rows = [("a", "t", "mint mint", None, {"category": "herb"}), ("b", "t", "mint", None, {"category": "herb"}), ("c", "t", "rose", None, {"category": "shrub"})]
    t = make(spark, rows)
    free = {r.record_id: r.lexical for r in t.query(ask(tenant_id="t", text="mint")).rows}
    bound = {r.record_id: r.lexical for r in t.query(ask(tenant_id="t", text="mint", scalar_eq={"category": "herb"})).rows}
    assert set(bound) == {"a", "b"} and bound["a"] < free["a"]


def test_provider_adds_a_stream(spark):
    class Fixed:
        name = "fixed"

        def open(self, view, spec, query, budget):
            from loomstone.operators.streams import ranked

            return ranked(view.where("record_id = 'ivy'").select("record_id", F.lit(1.0).alias("score"), F.lit(0.0).alias("penalty")), budget)

    t = make(spark, SEED)
    t.providers.append(Fixed())
    assert ids(t.query(ask(top_k=5))) == ["ivy", "fern"]


def test_strategy_labels():
    q = lambda **kw: HybridQuery("d", "t", **kw)
    assert strategy(q(vector=[1.0]), 10) == "PolicyPartitionFirst"
    assert strategy(q(vector=[1.0], text="x"), 100) == "HybridRecall"
    assert strategy(q(vector=[1.0]), 100) == "VectorFirst"
    assert strategy(q(text="x"), 1) == "TextFirst"
    assert strategy(q(), 1) == "RelationalFirst"


def test_strict_json_equality(spark):
    from loomstone.functions.predicates import equals

    docs = ['{"v":1}', '{"v":1.0}', '{"v":"1"}', '{"v":null}', "{}", '{"v":true}', '{"v":{"b":1,"a":[1,"x"]}}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").select("i", F.variant_get(F.parse_json("d"), "$.v", "variant").alias("v"))
    field = df.schema["v"]
    for value, want in ((1, [0]), (1.0, [1]), ("1", [2]), (None, [3]), (True, [5]), ({"a": [1, "x"], "b": 1}, [6]), (False, []), (2, [])):
        assert [r.i for r in df.where(equals(field, value)).orderBy("i").collect()] == want, value


def test_signed_pages_keep_to_their_snapshot(spark):
    """A later change is not seen by the pages that follow; a cursor of another query, actor or secret is refused."""
    rows = make(spark, [(x, "t", "same", None) for x in "abcd"]).rows
    later = rows.where("record_id = 'd'").withColumn("record_id", F.lit("bb")).withColumn("begin_epoch", F.lit(5).cast("long"))
    signer = Signer(b"secret")
    t = Table(rows, SPEC, signer=signer)
    first = t.query(ask(tenant_id="t", text="same", top_k=2))
    assert ids(first) == ["a", "b"] and first.next_cursor.startswith("lsc1.")
    grown = Table(rows.unionByName(later), SPEC, signer=signer)
    assert ids(grown.query(ask(tenant_id="t", text="same", top_k=2, cursor=first.next_cursor))) == ["c", "d"]
    assert ids(grown.query(ask(tenant_id="t", text="same", top_k=2))) == ["a", "b"] and ids(grown.query(ask(tenant_id="t", text="same", top_k=5))) == ["a", "b", "bb", "c", "d"]
    scanned = t.scan("t", 3).collect()
    assert [r.record_id for r in grown.scan("t", 3, scanned[0].next_cursor).collect()] == ["d"]
    for q, actor in ((ask(tenant_id="t", text="other", top_k=2, cursor=first.next_cursor), None), (ask(tenant_id="t", text="same", top_k=3, cursor=first.next_cursor), None), (ask(tenant_id="t", text="same", top_k=2, cursor=first.next_cursor), Actor("t", "x")), (ask(tenant_id="t", text="same", top_k=2, cursor="2"), None)):
        with pytest.raises(InvalidCursor):
            t.query(q, actor)
    with pytest.raises(InvalidCursor):
        Table(rows, SPEC, signer=Signer(b"other")).query(ask(tenant_id="t", text="same", top_k=2, cursor=first.next_cursor))


def test_the_view_is_planned_once(spark):
    """All streams read one exchange of the view: it is scanned once for them and once for the rows of the page."""
    path = "/root/testdata/sf0.001"
    from loomstone.plans import bindings as b

    q = HybridQuery("docs", "en", text="the of", vector=b.query_vector(spark, path), graph_seed="src3", temporal_as_of=50)
    plan = b.docs_table(spark, path).plan(q)
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= 6 and sum("FileScan" in line and "text" in line.split("ReadSchema")[1] for line in final.splitlines() if "ReadSchema" in line) == 2


def test_explanation_members(spark):
    t = make(spark, SEED + [("moss", "north", "damp", None, {"status": "Pending", "category": "x"})])
    e = t.query(ask(text="damp", scalar_eq={"category": "x"}, explain=True, top_k=1)).explain
    assert e.scalar_filter_applied and e.scalar_removed == 2 and e.scalar_visible == 1 and e.pending_features == 1 and e.budget == 8
    assert e.opened_streams[0] == "lexical" and set(e.skipped_streams) == {"vector", "graph", "temporal"} and e.text_candidates == 1 and e.vector_candidates == 0
    assert e.fusion_method == "ReciprocalRankFusion" and e.early_stop is None and set(e.phase_seconds) == {"visible", "streams", "fusion", "plan"}
    assert {s.stream: s.exhausted for s in e.streams} == {"lexical": True, "fallback": True}
