"""Folds of commits, stored tables, streams, cursors and operational events."""

from __future__ import annotations

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from loomstone import cursor
from loomstone.errors import Conflict, Corrupt, InvalidCommand, InvalidCursor, InvalidSchema, NotFound, NotPermitted
from loomstone.functions import values
from loomstone.model import TableSpec, VectorSpec
from loomstone.operators import operations, versions
from loomstone.sources.storage import Store, read_segment, segment_sets
from loomstone.streaming import commits as stream

SCHEMA = "tenant_id string, record_id string, epoch long, ordinal long, op string, fields map<string,string>"
COLUMNS = ["body", "status"]


def commits(spark, rows):
    return spark.createDataFrame([("t", *r) if len(r) == 5 else r for r in rows], SCHEMA)


def state(df, epoch=None):
    return {(r.tenant_id, r.record_id): (r.version_id, r.body, r.status) for r in versions.state_at(df, epoch, COLUMNS).collect()}


HISTORY = [
    ("a", 1, 0, "put", {"body": "one", "status": "new"}), ("a", 2, 0, "patch", {"body": "two"}), ("a", 3, 0, "patch", {"status": None}), ("a", 4, 0, "delete", {}),
    ("a", 5, 0, "patch", {"body": "back"}), ("b", 2, 0, "put", {"body": "x", "status": "s"}), ("b", 3, 0, "put", {"body": "y"}),
]


def test_patch_merges_put_replaces_delete_clears(spark):
    df = commits(spark, HISTORY)
    assert state(df, 1) == {("t", "a"): (1, "one", "new")}
    assert state(df, 2)[("t", "a")] == (2, "two", "new")
    assert state(df, 3) == {("t", "a"): (3, "two", None), ("t", "b"): (3, "y", None)}
    assert state(df, 4) == {("t", "b"): (3, "y", None)}
    assert state(df)[("t", "a")] == (5, "back", None)


def test_same_id_in_two_tenants(spark):
    df = commits(spark, [("t", "a", 1, 0, "put", {"body": "1"}), ("u", "a", 1, 0, "put", {"body": "2"}), ("u", "a", 2, 0, "delete", {})])
    assert state(df) == {("t", "a"): (1, "1", None)}


def test_last_of_a_batch_wins(spark):
    df = commits(spark, [("a", 1, 0, "put", {"body": "first"}), ("a", 1, 1, "put", {"body": "second"})])
    assert [(r.begin_epoch, r.op) for r in versions.versions(df).collect()] == [(1, "put")]
    assert state(df) == {("t", "a"): (1, "second", None)}


def test_versions_and_tombstones(spark):
    v = versions.versions(commits(spark, HISTORY))
    assert {(r.record_id, r.begin_epoch) for r in versions.visible_at(v, 3).collect()} == {("a", 3), ("b", 3)}
    assert [r.record_id for r in versions.tombstoned_at(v, 4).collect()] == ["a"]
    sealed = versions.visible_at(v, 3)
    assert [r.record_id for r in versions.sealed_minus_tombstones(sealed, v, 4).collect()] == ["b"]


def test_recovery_equals_the_whole_fold(spark):
    df = commits(spark, HISTORY)
    for at in range(1, 6):
        got = versions.recovered(versions.state_at(df, at, COLUMNS), at, df, COLUMNS)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, versions.state_at(df, None, COLUMNS).collect()))


def test_feature_states(spark):
    rows = [("a", 1, 0, "put", {"body": "x", "vec": "[1]"}), ("a", 2, 0, "patch", {"body": "y"}), ("a", 3, 0, "patch", {"status": "z"}), ("a", 4, 0, "patch", {"vec": "[2]"}), ("a", 5, 0, "delete", {}), ("a", 6, 0, "patch", {"status": "q"}), ("a", 7, 0, "status", {"set": "Failed"})]
    has = lambda k: F.map_contains_key("fields", F.lit(k))
    got = versions.feature_states(commits(spark, rows), has("vec"), has("body"), F.when(F.col("op") == "status", F.col("fields")["set"])).orderBy("epoch").collect()
    assert [r.status for r in got] == ["Ready", "Dirty", "Dirty", "Ready", "Missing", "Missing", "Failed"]


SPEC = TableSpec("docs", "id", "tenant", ("status",), ("body",), (VectorSpec("embedding", 3, ("body",)),))


def batch(spark, rows):
    return spark.createDataFrame([("docs", "t", r, i, op, f) for i, (r, op, f) in enumerate(rows)], "table string, tenant_id string, record_id string, ordinal long, op string, fields map<string,string>")


def live(store, epoch=None):
    return {r.record_id: r.body for r in store.state("docs", COLUMNS, epoch).collect()}


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    store.apply_schema(SPEC)
    assert store.append(batch(spark, [("a", "put", {"body": "1"}), ("b", "put", {"body": "2"})])) == 1
    assert store.append(batch(spark, [("a", "patch", {"body": "3"})]), "key") == 2
    assert store.append(batch(spark, [("a", "patch", {"body": "3"})]), "key") == 2
    with pytest.raises(Conflict):
        store.append(batch(spark, [("a", "patch", {"body": "4"})]), "key")
    for bad in ([], [("a", "drop", {})]):
        with pytest.raises(InvalidCommand):
            store.append(batch(spark, bad))
    assert live(store) == {"a": "3", "b": "2"} and live(store, 1) == {"a": "1", "b": "2"}
    with pytest.raises(InvalidSchema):
        store.apply_schema(dataclasses.replace(SPEC, id_column="key"))
    store.snapshot("before")
    with pytest.raises(Conflict):
        store.snapshot("before")
    store.append(batch(spark, [("b", "delete", {}), ("c", "put", {"body": "5"})]))
    before = live(store)
    store.checkpoint(drop_commits=True)
    assert live(store) == before == {"a": "3", "c": "5"} and store.commits().count() == 0
    store.append(batch(spark, [("c", "patch", {"body": "6"})]))
    assert live(store) == {"a": "3", "c": "6"}
    name = store.compact("docs", COLUMNS)
    rows = store.segment_rows().where("table = 'docs' and tenant_id = 't'")
    assert {r.record_id: r.body for r in rows.collect()} == live(store)
    sets = segment_sets(store.segment_rows()).first()
    assert (sets.table_set, sets.tenant_set) == (["docs"], ["t"])
    assert read_segment(spark, f"{store.root}/segments/{name}", "docs", "u").count() == 0
    store.compact("docs", COLUMNS)
    assert store.vacuum() == 1
    generation = store.manifest()["generation"]
    with pytest.raises(Conflict):
        store.publish("seg", rows, parent=generation - 1)
    store.restore("before")
    assert live(store) == {"a": "3", "b": "2"}
    with pytest.raises(NotFound):
        store.restore("nothing")
    for bad in ("../x", "a/b", "", ".hidden"):
        with pytest.raises(NotPermitted):
            store.snapshot(bad)


def test_manifest_damage(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    store.apply_schema(SPEC)
    good = store.manifest()
    path = tmp_path / "db" / "manifest.json"
    text = path.read_text()
    (tmp_path / "db" / ".manifest.json.crc").unlink(missing_ok=True)
    path.write_text(text[:20])
    assert store.manifest() == good
    raw = json.loads(text)
    raw["document"]["epoch"] = 99
    path.write_text(json.dumps(raw))
    with pytest.raises(Corrupt):
        store.manifest()


def test_uncommitted_files_are_not_read(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    store.apply_schema(SPEC)
    store.append(batch(spark, [("a", "put", {"body": "1"})]))
    batch(spark, [("a", "put", {"body": "lost"})]).write.parquet(f"{tmp_path}/db/commits/epoch=2")
    assert live(store) == {"a": "1"}
    assert store.append(batch(spark, [("a", "put", {"body": "2"})])) == 2
    assert live(store) == {"a": "2"}


def test_stream_keeps_the_state(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"file://{tmp_path}/out"
    df = commits(spark, HISTORY).withColumn("table", F.lit("docs")).select("table", *[c.split()[0] for c in SCHEMA.split(", ")[:5]], "fields")
    for low, high in ((1, 2), (3, 5)):
        df.where((F.col("epoch") >= low) & (F.col("epoch") <= high)).coalesce(1).write.mode("append").parquet(source)
        query = stream.maintain(stream.read(spark, source), target, COLUMNS, f"{tmp_path}/checkpoint")
        query.awaitTermination()
        got = sorted(map(tuple, stream.state(spark, target).collect()))
        assert got == sorted(map(tuple, versions.state_at(df.where(F.col("epoch") <= high), None, COLUMNS).collect()))


def test_cursors():
    scope = cursor.Scope("query", "t", "db", "main", "u", cursor.digest({"q": 1}), 10, "fused")
    token = cursor.encode(cursor.advance(cursor.begin(scope, 7, now=1000), 10), b"secret")
    got = cursor.decode(token, scope, b"secret", now=1001)
    assert (got.offset, got.epoch) == (10, 7)
    for wrong_scope in (dataclasses.replace(scope, tenant="u"), dataclasses.replace(scope, limit=11), dataclasses.replace(scope, query="x")):
        with pytest.raises(InvalidCursor):
            cursor.decode(token, wrong_scope, b"secret", now=1001)
    for bad in (token + "x", "1", token.replace("lsc1", "lsc2"), "lsc1.e30.AA"):
        with pytest.raises(InvalidCursor):
            cursor.decode(bad, scope, b"secret", now=1001)
    with pytest.raises(InvalidCursor):
        cursor.decode(token, scope, b"other", now=1001)
    with pytest.raises(InvalidCursor, match="expired"):
        cursor.decode(token, scope, b"secret", now=1000 + 3601)


JOB = "job_id string, seq long, kind string, lease_until long, not_before long, permanent boolean"


def test_jobs(spark):
    def fold(*kinds, permanent=False):
        rows = [("j", i, k, 100 + i if k in ("leased", "heartbeat") else None, 200 + i if k == "failed" else None, permanent if k == "failed" else None) for i, k in enumerate(kinds)]
        r = operations.final_job_states(spark.createDataFrame(rows, JOB)).first()
        return r.status, r.attempts, r.lease_until, r.not_before

    assert fold("enqueued") == ("Queued", 0, None, None)
    assert fold("enqueued", "leased", "heartbeat") == ("Leased", 1, 102, None)
    assert fold("enqueued", "leased", "completed") == ("Succeeded", 1, None, None)
    assert fold("enqueued", "leased", "failed") == ("FailedRetryable", 1, None, 202)
    assert fold("enqueued", "leased", "failed", permanent=True)[0] == "FailedPermanent"
    assert fold("enqueued", *["leased", "failed"] * 3)[:2] == ("DeadLettered", 3)


def test_leasable(spark):
    rows = [("Queued", None, None, True), ("FailedRetryable", None, 5, True), ("FailedRetryable", None, 15, False), ("Leased", 5, None, True), ("Running", 15, None, False), ("Leased", None, None, False), ("Succeeded", None, None, False)]
    df = spark.createDataFrame(rows, "status string, lease long, after long, want boolean")
    assert df.where(values.leasable(F.col("status"), F.col("lease"), F.col("after"), F.lit(10)) != F.col("want")).count() == 0


def test_idempotency_and_overlays(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 2, "x"), ("k", 3, "y"), ("l", 4, None), ("l", 5, None)], "key string, at long, body string")
    got = {r.at: r.outcome for r in operations.idempotent(df, ["key"], "at", "body").collect()}
    assert got == {1: "executed", 2: "replayed", 3: "conflict", 4: "executed", 5: "replayed"}
    events = spark.createDataFrame([("a", "Suppress", 2.0), ("a", "Recall", -1.0), ("b", "Recall", 3.0)], "id string, mode string, amount double")
    assert {r.record_id: r.penalty for r in operations.suppression(events, "id", "mode").collect()} == {"a": 1.0, "b": 0.0}
    assert {r.record_id: (r.level, r["count"]) for r in operations.activation(events, "id", "amount").collect()} == {"a": (2.0, 2), "b": (3.0, 1)}


def test_windowed_usage_and_late_duplicates_are_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "view", 2, "2024-01-01 00:10:00"), (1, "view", 2, "2024-01-01 00:10:00"), (2, "view", 3, "2024-01-01 01:10:00")], "id long, kind string, units long, at string").withColumn("at", F.col("at").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    once = stream.idempotent(source, ["id"], "at", "5 minutes")
    query = stream.windowed_usage(once, "at", "kind", "units", late=None).writeStream.outputMode("append").format("memory").queryName("usage").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.sql("select kind, units from usage").collect()
    assert {tuple(r) for r in got} <= {("view", 2), ("view", 3)} and ("view", 2) in {tuple(r) for r in got}


def test_statements(spark, tmp_path):
    from loomstone.errors import DimensionMismatch, IdentityMismatch, TenantMismatch
    from loomstone.languages.commands import Session
    from loomstone.model import Actor

    s = Session(Store(spark, f"file://{tmp_path}/db"), Actor("t"))
    s.run('SCHEMA APPLY {"name": "docs", "scalars": ["status"], "texts": ["body"], "vectors": [{"name": "embedding", "dimensions": 3, "sources": ["body"]}]}')
    put = 'RECORD PUT {"table": "docs", "tenant_id": "t", "id": "%s", "fields": %s}'
    assert s.run(put % ("a", '{"id": "a", "body": "rust database kernel", "status": 1, "embedding": [1, 0, 0]}')) == {"epoch": 1}
    s.run('BATCH {"records": [{"table": "docs", "tenant_id": "t", "id": "b", "fields": {"body": "vector fusion", "status": "1", "embedding": [0.9, 0.1, 0]}}, {"table": "docs", "tenant_id": "t", "id": "c", "fields": {"body": "gone"}}]}')
    s.run('DELETE {"table": "docs", "tenant_id": "t", "id": "c"}')
    page = s.run('FROM docs\nTENANT t\nMATCH body "rust kernel"\nNEAR embedding [1, 0, 0]\nLIMIT 5\nEXPLAIN')
    assert [r["record_id"] for r in page["results"]] == ["a", "b"] and page["explain"].features == {"embedding:Ready": 2}
    assert [r["record_id"] for r in s.run("SELECT * FROM docs WHERE tenant_id = 't' AND status = 1")["results"]] == ["a"]
    assert [r["record_id"] for r in s.run('QUERY {"table": "docs", "tenant_id": "t", "scalar_eq": {"status": "1"}}')["results"]] == ["b"]
    s.run('PATCH {"table": "docs", "tenant_id": "t", "id": "a", "fields": {"body": "rust rewritten"}}')
    near = 'QUERY {"table": "docs", "tenant_id": "t", "vector": [1, 0, 0], "freshness": "%s"}'
    score = lambda mode: {r["record_id"]: r["score"]["vector"] for r in s.run(near % mode)["results"]}
    for _ in range(2):
        assert score("Strict")["a"] is None and score("AllowDirty")["a"] == pytest.approx(0.95)
        s.run('ADMIN CHECKPOINT {"drop_commits": true}')
    assert s.run('GET {"table": "docs", "tenant_id": "t", "id": "a"}')["fields"]["body"] == "rust rewritten"
    assert s.run('SCAN {"table": "docs", "tenant_id": "t", "limit": 1}') == {"records": ["a"], "next_cursor": "1"}
    s.run('ADMIN SNAPSHOT {"name": "one"}')
    s.run('COMPACT {"table": "docs"}')
    s.run('RESTORE {"name": "one"}')
    for bad, error in (
        (put % ("x", '{"id": "y"}'), IdentityMismatch), (put % ("x", '{"embedding": [1]}'), DimensionMismatch), ('GET {"table": "docs", "tenant_id": "u", "id": "a"}', TenantMismatch),
        ('GET {"table": "docs", "tenant_id": "t", "id": "c"}', NotFound), ('GET {"table": "nope", "tenant_id": "t", "id": "c"}', NotFound), ("PUT {x", InvalidCommand), ("", InvalidCommand), ('PUT {"table": "docs"}', InvalidCommand),
    ):
        with pytest.raises(error):
            s.run(bad)
