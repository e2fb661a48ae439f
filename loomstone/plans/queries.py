"""Registered queries of the engine's operators, each with its DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import policy, predicates, text, values
from loomstone.functions import vector as vector_fn
from loomstone.model import Actor, Freshness, HybridQuery
from loomstone.operators import fusion, graph, hnsw, operations, scans, streams, versions
from loomstone.plans import bindings as b
from loomstone.plans import oracle as o
from loomstone.plans.hybrid import Table
from loomstone.sources import storage, tables
from loomstone.sources.jobs import Queue

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TENANT, USER, SOURCE = "en", "u3", "src3"
TERMS = "the nation of ation"
TIED = "qqqqq"
#: Epoch of the as-of queries, and of sealing.
AT, SEALED = 700, 400
COLUMNS = ["event_type", "value", "props"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='loomstone-store-')}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _docs(sql: str) -> str:
    return f"WITH {b.DOCS_SQL}\n{sql}"


def _events(sql: str, *ctes: str, commits: str = b.ONE_SQL) -> str:
    return "WITH " + ",".join([commits, *ctes]) + "\n" + sql


# Scans.


@query(_docs(f"SELECT record_id, source, n_chars FROM docs WHERE tenant_id = '{TENANT}'"))
def tenant_scan(spark, sf):
    return scans.tenant(b.docs(spark, sf), TENANT).select("record_id", "source", "n_chars")


@query(_docs(f"SELECT record_id, n_chars, '30' AS next_cursor FROM docs WHERE tenant_id = '{TENANT}' ORDER BY record_id LIMIT 10 OFFSET 20"))
def scan_page(spark, sf):
    return b.docs_table(spark, sf).scan(TENANT, 10, "20").select("record_id", "n_chars", "next_cursor")


@query(_events(
    "SELECT record_id, version_id, CASE WHEN (SELECT count(*) FROM seen) > 5 THEN '5' END AS next_cursor FROM seen ORDER BY record_id LIMIT 5",
    b.VERSIONS_SQL, f"seen AS (SELECT * FROM versions WHERE tenant_id = 't1' AND begin_epoch <= {AT} AND (end_epoch IS NULL OR end_epoch > {AT}) AND tombstone IS NULL)",
))
def scan_page_as_of(spark, sf):
    rows = versions.visible_at(versions.versions(b.commits(spark, sf)), AT)
    Actor("t1").for_tenant("t1")
    return scans.page(rows, "t1", 5).select("record_id", "version_id", "next_cursor")


@query(_docs(f"SELECT record_id, source, text FROM docs WHERE tenant_id = '{TENANT}' AND record_id = '42'"))
def point_get(spark, sf):
    return b.docs_table(spark, sf).get(TENANT, "42").select("record_id", "source", "text")


@query(_events(
    f"SELECT tenant_id, record_id, version_id, op FROM versions WHERE begin_epoch <= {AT} AND (end_epoch IS NULL OR end_epoch > {AT}) AND tombstone IS NULL", b.VERSIONS_SQL
))
def snapshot_at_epoch(spark, sf):
    return versions.visible_at(versions.versions(b.commits(spark, sf)), AT).select("tenant_id", "record_id", "version_id", "op")


@query(_docs(f"SELECT record_id, source, n_chars FROM docs WHERE tenant_id = '{TENANT}'"))
def sealed_scan_pruned(spark, sf):
    path = _folder(spark, "segment")
    storage.write_partitioned(b.docs(spark, sf).select(F.lit("docs").alias("table"), "tenant_id", "record_id", "source", "n_chars"), path)
    return storage.read_segment(spark, path, "docs", TENANT).select("record_id", "source", "n_chars")


@query(_events("SELECT epoch, ordinal, tenant_id, record_id, op FROM commits", commits=b.BATCH_SQL))
def commit_log_scan(spark, sf):
    """All batches of events, loaded into a log in one job and read back."""
    store = storage.Store(spark, _folder(spark, "log"))
    store.append_epochs(b.commits(spark, sf, batched=True))
    return store.commits().select("epoch", "ordinal", "tenant_id", "record_id", "op")


@query(_events("SELECT tenant_id, record_id, epoch, ordinal, 'value' AS feature, 'Dirty' AS status FROM commits WHERE op <> 'delete' AND value IS NULL", commits=b.BATCH_SQL))
def feature_invalidations(spark, sf):
    """A change that names the event type, and not the value that is derived from it, makes the value stale."""
    return versions.invalidations(b.commits(spark, sf, batched=True), {"value": ("event_type",)})


_STATE = "SELECT tenant_id, record_id, version_id, event_type, value, props FROM state WHERE op <> 'delete'"


def _typed(state: DataFrame) -> DataFrame:
    return state.select("tenant_id", "record_id", "version_id", "event_type", F.col("value").cast("double").alias("value"), "props")


@query(_events(_STATE, b.STATE_SQL.format(at="9e18")))
def recover_state(spark, sf):
    commits = b.commits(spark, sf)
    path = _folder(spark, "checkpoint")
    versions.state_at(commits, SEALED, COLUMNS).write.parquet(path)
    return _typed(versions.recovered(spark.read.parquet(path), SEALED, commits, COLUMNS))


@query(_events(_STATE, b.STATE_SQL.format(at="9e18")))
def compact_equivalence(spark, sf):
    """Two tables in one store: the events, and half of them under another name. Each is compacted, and the first one read back."""
    store = storage.Store(spark, _folder(spark, "compact"))
    commits = b.commits(spark, sf).withColumn("ordinal", F.col("epoch")).drop("epoch")
    store.append(commits.unionByName(commits.where(F.col("ordinal") % 2 == 0).withColumn("table", F.lit("others"))))
    store.compact("users", COLUMNS)
    store.compact("others", COLUMNS)
    store.vacuum()
    rows = store.segment_rows("users")
    newest = b.commits(spark, sf).groupBy("tenant_id", "record_id").agg(F.max("epoch").alias("epoch"))
    return _typed(rows.join(newest, ["tenant_id", "record_id"]).withColumn("version_id", F.col("epoch")))


# Visibility and filters.


@query(_events(f"SELECT record_id, version_id FROM versions WHERE begin_epoch <= {SEALED} AND (end_epoch IS NULL OR end_epoch > {SEALED}) AND tombstone IS NULL", b.VERSIONS_SQL))
def mvcc_visible_at_epoch(spark, sf):
    return versions.visible_at(versions.versions(b.commits(spark, sf)), SEALED).select("record_id", "version_id")


_LIVE = "begin_epoch <= {0} AND (end_epoch IS NULL OR end_epoch > {0})"


@query(_events(
    f"SELECT tenant_id, record_id, version_id FROM versions WHERE {_LIVE.format(SEALED)} AND tombstone IS NULL "
    f"AND (tenant_id, record_id) NOT IN (SELECT (tenant_id, record_id) FROM versions WHERE {_LIVE.format(AT)} AND tombstone IS NOT NULL)",
    b.VERSIONS_SQL,
))
def sealed_minus_tombstones(spark, sf):
    rows = versions.versions(b.commits(spark, sf))
    return versions.sealed_minus_tombstones(versions.visible_at(rows, SEALED), rows, AT).select("tenant_id", "record_id", "version_id")


def _filtered(spark, sf, wanted):
    return predicates.scalar_eq(scans.tenant(b.docs(spark, sf), TENANT), b.DOCS, wanted).select("record_id", "source", "n_chars")


@query(_docs(f"SELECT record_id, source, n_chars FROM docs WHERE tenant_id = '{TENANT}' AND source = '{SOURCE}'"))
def scalar_eq_filter(spark, sf):
    return _filtered(spark, sf, {"source": SOURCE})


@query(_docs(f"SELECT record_id, source, n_chars FROM docs WHERE tenant_id = '{TENANT}' AND source = 'src1' AND n_chars = 416"))
def scalar_eq_multi(spark, sf):
    return _filtered(spark, sf, {"source": "src1", "n_chars": 416})


@query(_docs("SELECT record_id, source, n_chars FROM docs WHERE false"))
def scalar_eq_type_mismatch(spark, sf):
    return _filtered(spark, sf, {"n_chars": "416"})


@query(_docs(f"SELECT DISTINCT record_id FROM docs WHERE tenant_id = '{TENANT}' AND source = '{SOURCE}'"))
def bitmap_visible_ids(spark, sf):
    return scans.bitmap_ids(b.docs(spark, sf), TENANT, source=SOURCE)


@query(_docs(f"SELECT record_id, visibility FROM docs WHERE {o.visible(TENANT)}"))
def policy_visible(spark, sf):
    return b.docs(spark, sf).where(policy.visible(F.col("policy"), Actor(TENANT))).select("record_id", F.col("policy.visibility").alias("visibility"))


@query(_docs(f"SELECT record_id, visibility FROM docs WHERE {o.visible(TENANT, USER)} AND visibility = 'Acl'"))
def policy_acl(spark, sf):
    rows = b.docs(spark, sf).where(policy.visible(F.col("policy"), Actor(TENANT, USER)))
    return rows.where("policy.visibility = 'Acl'").select("record_id", F.col("policy.visibility").alias("visibility"))


@query(_docs(f"""
SELECT record_id, array_to_string(list_filter([CASE WHEN tenant_id <> '{TENANT}' THEN 'tenant_mismatch' END, CASE WHEN visibility = 'Hidden' THEN 'hidden' END,
  CASE WHEN visibility = 'Acl' AND allowed <> '{USER}' THEN 'acl_denied' END, CASE WHEN suppressed THEN 'suppress_from_ai' END], lambda r: r IS NOT NULL), ',') AS reasons
FROM docs"""))  # fmt: skip
def policy_deny_reasons(spark, sf):
    return b.docs(spark, sf).select("record_id", F.array_join(policy.deny_reasons(F.col("policy"), Actor(TENANT, USER)), ",").alias("reasons"))


@query(_docs("""
SELECT record_id, CASE doc_id % 5 WHEN 0 THEN visibility ELSE 'Tenant' END AS visibility, CASE WHEN doc_id % 5 = 0 THEN suppressed ELSE false END AS suppressed FROM docs"""))
def policy_default_open(spark, sf):
    """Policies as JSON text: whole, torn, absent, without a member, and with an unknown visibility."""
    rows, n = b.docs(spark, sf), F.col("record_id").cast("long") % 5
    whole = F.to_json("policy")
    stated = F.when(n == 0, whole).when(n == 1, F.substring(whole, 1, 20)).when(n == 2, F.lit(None)).when(n == 3, F.to_json(F.col("policy").dropFields("sensitivity"))).otherwise(F.lit('{"visibility":"Everyone"}'))
    p = policy.parsed(stated, F.col("tenant_id"))
    return rows.select("record_id", p["visibility"].alias("visibility"), p["suppress_from_ai"].alias("suppressed"))


# Text.


def _tenant_text(spark, sf):
    return scans.tenant(b.docs(spark, sf), TENANT)


_V = f"v AS (SELECT * FROM docs WHERE tenant_id = '{TENANT}')"


def _text_sql(sql: str, query_text: str = TERMS, expr: str = "coalesce(text, '')") -> str:
    return f"WITH {b.DOCS_SQL},{_V},{o.bm25('v', expr, query_text)}\n{sql}"


@query(_text_sql("SELECT CAST(n AS BIGINT) AS doc_count, round(avgdl, 6) AS avg_len FROM st"))
def bm25_corpus_stats(spark, sf):
    stats = text.corpus(text.counted(_tenant_text(spark, sf), ["text"], text.query_terms(TERMS)), 4)
    return stats.select(F.col("n").alias("doc_count"), F.round("avgdl", 6).alias("avg_len"))


@query(_text_sql("SELECT unnest(['the', 'nation', 'of', 'ation']) AS term, CAST(unnest([df0, df1, df2, df3]) AS BIGINT) AS df FROM st"))
def bm25_document_frequency(spark, sf):
    terms = text.query_terms(TERMS)
    stats = text.corpus(text.counted(_tenant_text(spark, sf), ["text"], terms), len(terms))
    return stats.select(F.explode(F.arrays_zip(F.array(*[F.lit(t) for t in terms]).alias("term"), F.col("df"))).alias("x")).select("x.term", F.col("x.df").alias("df"))


@query(_text_sql("SELECT record_id, CAST(tf0 AS BIGINT) AS tf_the, CAST(tf2 AS BIGINT) AS tf_of, CAST(dl AS BIGINT) AS dl FROM cnt"))
def bm25_term_frequency(spark, sf):
    rows = text.counted(_tenant_text(spark, sf), ["text"], text.query_terms(TERMS))
    return rows.select("record_id", F.col("tf")[0].cast("long").alias("tf_the"), F.col("tf")[2].cast("long").alias("tf_of"), F.col("dl").cast("long").alias("dl"))


@query(_docs(f"SELECT record_id, CAST(len({o.TOKENS.format(text='text')}) AS BIGINT) AS n, CAST(len(list_distinct({o.TOKENS.format(text='text')})) AS BIGINT) AS n_distinct FROM docs"))
def tokenize_counts(spark, sf):
    toks = text.tokens(F.col("text"))
    return b.docs(spark, sf).select("record_id", F.size(toks).cast("long").alias("n"), F.size(F.array_distinct(toks)).cast("long").alias("n_distinct"))


def _top(scored: DataFrame, n: int = 20) -> DataFrame:
    return scored.select("record_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "record_id").limit(n)


_TOP_SQL = "SELECT record_id, score FROM scored WHERE score > 0 ORDER BY score DESC, record_id LIMIT 20"


@query(_text_sql(_TOP_SQL))
def bm25_topk(spark, sf):
    return _top(text.bm25(_tenant_text(spark, sf), ["text"], TERMS))


@query(_text_sql(_TOP_SQL, "the the nation"))
def bm25_repeated_term(spark, sf):
    return _top(text.bm25(_tenant_text(spark, sf), ["text"], "the the nation"))


@query(_text_sql(_TOP_SQL))
def bm25_prepared(spark, sf):
    """The same scores from written postings of the tenant's corpus."""
    path = _folder(spark, "postings")
    text.postings(_tenant_text(spark, sf), ["text"]).write.parquet(path)
    return _top(text.prepared(spark.read.parquet(path), TERMS))


@query(_text_sql("SELECT * FROM (SELECT record_id, CAST(dl AS BIGINT) AS dl, CAST(unnest([tf0, tf1, tf2, tf3]) AS BIGINT) AS tf, unnest(['the', 'nation', 'of', 'ation']) AS term FROM cnt) WHERE tf > 0"))
def text_postings(spark, sf):
    """Postings of the query's terms as an index holds them."""
    index = text.postings(_tenant_text(spark, sf), ["text"])
    return index.where(F.col("term").isin(*text.query_terms(TERMS))).select("record_id", F.col("dl").cast("long").alias("dl"), "tf", "term")


@query(_text_sql(_TOP_SQL, "src3 the", "concat_ws(' ', text, source)"))
def bm25_multi_field(spark, sf):
    return _top(text.bm25(_tenant_text(spark, sf), ["text", "source"], "src3 the"))


# Vectors.


def _vector_sql(dirty: bool, sql: str) -> str:
    return f"WITH {b.DOCS_SQL},{_V},{o.vector_cte('v', dirty)}\n{sql}"


def _vectors(spark, sf, mode: Freshness, n: int) -> DataFrame:
    q = HybridQuery("docs", TENANT, vector=b.query_vector(spark, sf), freshness=mode)
    return streams.vector(_tenant_text(spark, sf), b.DOCS, q, n).select("record_id", "score", "penalty", "rank")


_VTOP = "SELECT record_id, score, penalty, row_number() OVER (ORDER BY score DESC, record_id) AS rank FROM vscored ORDER BY score DESC, record_id LIMIT 20"


@query(_vector_sql(False, _VTOP))
def vector_topk(spark, sf):
    return _vectors(spark, sf, Freshness.STRICT, 20)


@query(_vector_sql(True, _VTOP))
def vector_topk_allow_dirty(spark, sf):
    return _vectors(spark, sf, Freshness.ALLOW_DIRTY, 20)


def _fresh(spark, sf, mode: Freshness) -> DataFrame:
    score, off = streams.vector_score(F.col("embedding"), F.col("feature_status")["embedding"], HybridQuery("docs", TENANT, vector=b.query_vector(spark, sf), freshness=mode))
    return _tenant_text(spark, sf).select("record_id", score.alias("score"), off.alias("penalty")).where("score is not null")


_FRESH = "SELECT record_id, score, penalty FROM vscored"


@query(_vector_sql(False, _FRESH))
def freshness_strict(spark, sf):
    return _fresh(spark, sf, Freshness.STRICT)


@query(_vector_sql(False, _FRESH))
def freshness_lazy(spark, sf):
    return _fresh(spark, sf, Freshness.LAZY)


@query(_vector_sql(True, _FRESH))
def freshness_allow_dirty(spark, sf):
    return _fresh(spark, sf, Freshness.ALLOW_DIRTY)


@query(_docs(f"SELECT record_id, round({o.cosine()}, 6) AS similarity FROM docs WHERE embedding IS NOT NULL"))
def cosine_all(spark, sf):
    return b.docs(spark, sf).where("embedding is not null").select("record_id", F.round(vector_fn.cosine(F.col("embedding"), b.query_vector(spark, sf)), 6).alias("similarity"))


@query(f"SELECT rank, id, score FROM (SELECT CAST(vec_id AS VARCHAR) AS id, round({o.cosine()}, 6) AS score, row_number() OVER (ORDER BY round({o.cosine()}, 6) DESC, CAST(vec_id AS VARCHAR)) AS rank FROM embeddings) WHERE rank <= 10")
def hnsw_topk(spark, sf):
    """The nearest of one vector, through a stored index of all vectors; wide enough a search to equal the exact answer."""
    path = _folder(spark, "hnsw")
    vectors = b.table(spark, sf, "embeddings").select(F.lit("embedding").alias("field"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    hnsw.build(vectors).write.parquet(path)
    asked = b.table(spark, sf, "embeddings").where("vec_id = 0").select(F.lit(0).alias("query_id"), F.lit("embedding").alias("field"), F.col("embedding").alias("vector"))
    found = hnsw.search(spark.read.parquet(path), asked, 10, ef=400)
    return found.select("rank", "id", F.round("score", 6).alias("score"))


# Hybrid queries.


def _plan(spark, sf, offset: int = 0, **members) -> DataFrame:
    q = HybridQuery("docs", TENANT, **members)
    rows = b.docs_table(spark, sf).plan(q, offset=offset)
    return rows.drop("text").withColumn("final_score", F.round("final_score", 9))


@query(o.hybrid(TENANT, TERMS, True))
def hybrid_text_vector(spark, sf):
    return _plan(spark, sf, text=TERMS, vector=b.query_vector(spark, sf))


@query(o.hybrid(TENANT, TERMS, True))
def hybrid_sealed_segments(spark, sf):
    """Half of the documents live only in published segments; the query sees all of them once."""
    rows = b.docs(spark, sf)
    store = storage.Store(spark, _folder(spark, "sealed"))
    odd = F.col("record_id").cast("long") % 2 == 1
    store.publish("first", rows.where(odd | (F.col("record_id").cast("long") % 10 == 0)).select(F.lit("docs").alias("table"), "*"))
    sealed = store.segment_rows("docs").select(*rows.columns)
    hot = rows.where(~odd)
    table = Table(tables.with_sealed(hot, sealed, hot), b.DOCS)
    plan = table.plan(HybridQuery("docs", TENANT, text=TERMS, vector=b.query_vector(spark, sf)))
    return plan.drop("text").withColumn("final_score", F.round("final_score", 9))


@query(o.hybrid(TENANT, TERMS, True, top_k=5))
def hybrid_lexical_first(spark, sf):
    return _plan(spark, sf, text=TERMS, vector=b.query_vector(spark, sf), top_k=5)


@query(o.hybrid(TENANT, TIED, True, top_k=10))
def hybrid_vector_when_tied(spark, sf):
    return _plan(spark, sf, text=TIED, vector=b.query_vector(spark, sf))


@query(o.hybrid(TENANT, TERMS, True, top_k=10, offset=10))
def hybrid_page_2(spark, sf):
    return _plan(spark, sf, 10, text=TERMS, vector=b.query_vector(spark, sf))


@query(o.hybrid(TENANT, None, False))
def fallback_only(spark, sf):
    return _plan(spark, sf)


@query(o.hybrid(TENANT, None, False, graph=SOURCE, top_k=30))
def graph_seed_stream(spark, sf):
    return _plan(spark, sf, graph_seed=SOURCE, top_k=30)


@query(o.hybrid(TENANT, None, False, at=500, top_k=30))
def temporal_stream(spark, sf):
    return _plan(spark, sf, temporal_as_of=500, top_k=30)


@query(o.hybrid(TENANT, TERMS, True, True, SOURCE, 500, 20))
def hybrid_all_streams(spark, sf):
    return _plan(spark, sf, text=TERMS, vector=b.query_vector(spark, sf), freshness=Freshness.ALLOW_DIRTY, graph_seed=SOURCE, temporal_as_of=500, top_k=20)


@query(o.hybrid(TENANT, TERMS, False, where=f"source = '{SOURCE}'"))
def hybrid_scalar_filter(spark, sf):
    return _plan(spark, sf, text=TERMS, scalar_eq={"source": SOURCE})


@query(o.hybrid(TENANT, None, False).replace("position <= 10", "false"))
def topk_zero(spark, sf):
    return _plan(spark, sf, top_k=0)


def _two_streams(spark, sf) -> dict[str, DataFrame]:
    view = _tenant_text(spark, sf)
    q = HybridQuery("docs", TENANT, text=TERMS, vector=b.query_vector(spark, sf))
    return {"lexical": streams.lexical(view, b.DOCS, q, 40), "vector": streams.vector(view, b.DOCS, q, 40)}


_TWO = f"WITH {b.DOCS_SQL},{_V},{o.bm25('v', 'text', TERMS)},{o.ranked('lexical', 'scored', 'score', '0.0', 40, 'score > 0')},{o.vector_cte('v', False)},{o.ranked('vector', 'vscored', 'score', 'penalty', 40)}"
_TWO_FUSED = "SELECT coalesce(l.record_id, w.record_id) AS record_id, l.score AS lexical, w.score AS vector, coalesce(1.0e0 / (60 + l.rank), 0) + coalesce(1.0e0 / (60 + w.rank), 0) - greatest(coalesce(w.penalty, 0), 0) AS final FROM lexical l FULL JOIN vector w ON l.record_id = w.record_id"


@query(f"{_TWO}\nSELECT record_id, lexical, vector, round(final, 9) AS final FROM ({_TWO_FUSED})")
def rrf_fuse_two_streams(spark, sf):
    return fusion.fuse(_two_streams(spark, sf)).select("record_id", "lexical", "vector", F.round("final", 9).alias("final"))


@query(f"{_TWO},{o.ranked('fallback', 'v', '1.0', '0.0', 40)},f AS ({_TWO_FUSED})\nSELECT record_id, 0 AS tier, round(final, 9) AS final FROM f UNION ALL SELECT record_id, 1, round(3.0e0 / (60 + rank), 9) FROM fallback WHERE record_id NOT IN (SELECT record_id FROM f)")
def evidence_then_fallback(spark, sf):
    fused = fusion.with_fallback(fusion.fuse(_two_streams(spark, sf)), streams.fallback(_tenant_text(spark, sf), 40))
    return fused.select("record_id", "tier", F.round("final", 9).alias("final"))


@query(f"{_TWO},f AS ({_TWO_FUSED})\nSELECT round(max(lexical) - min(lexical), 6) AS spread, coalesce(max(lexical) - min(lexical) <= 1e-6, true) AS tied FROM f")
def lexical_tie_detection(spark, sf):
    return fusion.lexical_spread(fusion.fuse(_two_streams(spark, sf))).select(F.round("spread", 6).alias("spread"), "tied")


@query(f"{_TWO}\nSELECT count(*) AS checked, CAST(count(*) FILTER (record_id NOT IN (SELECT record_id FROM docs WHERE {o.visible(TENANT)})) AS BIGINT) AS removed FROM ({_TWO_FUSED})")
def guard_removed_count(spark, sf):
    return fusion.guard_counts(fusion.fuse(_two_streams(spark, sf)), b.docs_table(spark, sf).view(HybridQuery("docs", TENANT)))


@query(_docs(f"SELECT record_id, CASE WHEN doc_id % 2 = 0 THEN 'hot' ELSE 'sealed' END AS origin, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE -n_chars END AS n_chars FROM (SELECT * FROM docs WHERE tenant_id = '{TENANT}' ORDER BY record_id LIMIT 50)"))
def late_materialize_hot_over_sealed(spark, sf):
    rows = _tenant_text(spark, sf)
    hot = rows.where("cast(record_id as long) % 2 = 0")
    sealed = rows.withColumn("n_chars", -F.col("n_chars"))
    few = streams.fallback(rows, 50).select("record_id")
    return fusion.materialize(few, hot, sealed, ["n_chars"])


# Graph and time.

_EDGES = "edges AS (SELECT l_orderkey AS src, l_partkey AS dst, l_linestatus AS tenant_id, l_returnflag = 'R' AS hidden FROM lineitem)"


def _edges(spark, sf):
    return b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linestatus").alias("tenant_id"), (F.col("l_returnflag") == "R").alias("hidden"))


@query(f"WITH {_EDGES}\nSELECT DISTINCT src, dst FROM edges WHERE tenant_id = 'O' AND NOT hidden")
def graph_visible_neighbors(spark, sf):
    return graph.all_neighbors(_edges(spark, sf), (F.col("tenant_id") == "O") & ~F.col("hidden"))


@query(f"WITH {_EDGES}\nSELECT DISTINCT dst FROM edges WHERE src = 7 AND NOT hidden")
def graph_neighbors_of(spark, sf):
    return graph.neighbors(_edges(spark, sf), 7, ~F.col("hidden"))


@query(_docs("SELECT record_id FROM docs WHERE valid_from <= 500 AND 500 <= valid_to"))
def temporal_as_of(spark, sf):
    return b.docs(spark, sf).where(values.contains_epoch(F.col("valid_from"), F.col("valid_to"), F.lit(500))).select("record_id")


@query("SELECT l_orderkey AS record_id FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_partkey <= 1000 AND 1000 <= l_partkey + 100 * l_linenumber)")
def temporal_any_range(spark, sf):
    r = F.struct(F.col("l_partkey").alias("begin"), (F.col("l_partkey") + 100 * F.col("l_linenumber")).alias("end"))
    rows = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.collect_list(r).alias("ranges"))
    return rows.where(graph.any_range_holds(F.col("ranges"), F.lit(1000))).select("record_id")


@query("SELECT conv_id, turn, CASE WHEN turn > 0 THEN [CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR)] ELSE [] END[1] AS parent FROM conversations")
def provenance_parents(spark, sf):
    name = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    rows = b.table(spark, sf, "conversations").withColumn("parents", F.when(F.col("turn") > 0, F.array(name)).otherwise(F.array().cast("array<string>")))
    return operations.provenance(rows, "conversation", "conv_id", "parents").select("conv_id", "turn", F.try_element_at("provenance.parent_records", F.lit(1)).alias("parent"))


# Versions.


@query(_events("SELECT tenant_id, record_id, version_id, coalesce(end_epoch, -1) AS end_epoch, op, tombstone FROM versions", b.VERSIONS_SQL))
def scd2_versions(spark, sf):
    return versions.versions(b.commits(spark, sf)).select("tenant_id", "record_id", "version_id", F.coalesce("end_epoch", F.lit(-1)).alias("end_epoch"), "op", "tombstone")


@query(_events("SELECT tenant_id, record_id, version_id, coalesce(end_epoch, -1) AS end_epoch, op FROM versions", b.VERSIONS_SQL, commits=b.BATCH_SQL))
def batch_last_wins(spark, sf):
    return versions.versions(b.commits(spark, sf, batched=True)).select("tenant_id", "record_id", "version_id", F.coalesce("end_epoch", F.lit(-1)).alias("end_epoch"), "op")


@query(_events(_STATE, b.STATE_SQL.format(at=str(AT))))
def patch_merge(spark, sf):
    return _typed(versions.state_at(b.commits(spark, sf), AT, COLUMNS))


@query(_events(f"SELECT tenant_id, record_id FROM versions WHERE {_LIVE.format(AT)} AND tombstone IS NOT NULL", b.VERSIONS_SQL))
def delete_hides(spark, sf):
    return versions.tombstoned_at(versions.versions(b.commits(spark, sf)), AT)


_FEATURES = """
generations AS (
  SELECT *, sum(CASE WHEN op IN ('put', 'delete') THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, record_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS generation,
         {said} AS said
  FROM commits
),
states AS (
  SELECT *, coalesce(last_value(said IGNORE NULLS) OVER (PARTITION BY tenant_id, record_id, generation ORDER BY epoch ROWS UNBOUNDED PRECEDING), 'Missing') AS status FROM generations
)"""
_SAID = "CASE event_type WHEN 'purchase' THEN 'Ready' WHEN 'click' THEN 'Dirty' END"
_OVERRIDDEN = f"CASE WHEN epoch % 10 = 0 THEN 'Failed' ELSE {_SAID} END"


def _features(spark, sf, override=None) -> DataFrame:
    kind = F.col("fields")["event_type"]
    return versions.feature_states(b.commits(spark, sf), kind == "purchase", kind == "click", override).select("tenant_id", "record_id", "epoch", "status")


@query(_events("SELECT tenant_id, record_id, epoch, status FROM states", _FEATURES.format(said=_SAID)))
def feature_state_after_writes(spark, sf):
    return _features(spark, sf)


@query(_events("SELECT tenant_id, record_id, epoch, status FROM states", _FEATURES.format(said=_OVERRIDDEN)))
def feature_state_override(spark, sf):
    return _features(spark, sf, F.when(F.col("epoch") % 10 == 0, "Failed"))


@query(_docs("SELECT status, count(*) AS n FROM docs GROUP BY status"))
def feature_status_counts(spark, sf):
    return operations.status_counts(b.docs(spark, sf).select(F.col("feature_status")["embedding"].alias("status")))


@query(_docs("SELECT record_id FROM docs WHERE doc_id % 97 = 0 OR doc_id % 89 = 0"))
def identity_violations(spark, sf):
    """Ids that disagree are planted in every 97th record, tenants in every 89th."""
    i = F.col("record_id").cast("long")
    rows = b.docs(spark, sf).withColumns({"id": F.when(i % 97 == 0, "x").otherwise(F.col("record_id")), "tenant": F.when(i % 89 == 0, "").otherwise(F.col("tenant_id"))})
    return versions.identity_violations(rows, "id", "tenant").select("record_id")


@query(_docs("SELECT record_id FROM docs WHERE embedding IS NOT NULL AND doc_id % 50 = 0"))
def dimension_violations(spark, sf):
    rows = b.docs(spark, sf).withColumn("embedding", F.when(F.col("record_id").cast("long") % 50 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    return versions.dimension_violations(rows, "embedding", b.DIMENSIONS).select("record_id")


# Hashes and lifecycle.


@query(_docs("""SELECT record_id, sha256('source="' || source || '"' || chr(0) || 'n_chars=' || CAST(n_chars AS VARCHAR) || chr(0)) AS hash FROM docs""".replace("'source=\"' || source || '\"'", "'source=' || '\"' || source || '\"'")))
def source_hash_hex(spark, sf):
    quoted = F.concat(F.lit('"'), F.col("source"), F.lit('"'))
    return b.docs(spark, sf).select("record_id", values.source_hash([("source", quoted), ("n_chars", F.col("n_chars").cast("string"))]).alias("hash"))


@query(_docs("SELECT record_id, 'sha256:' || sha256(text) AS hash FROM docs"))
def body_hash(spark, sf):
    return b.docs(spark, sf).select("record_id", values.body_hash(F.col("text")).alias("hash"))


@query("""
SELECT status, mode, CASE mode WHEN 'Strict' THEN status = 'Ready' WHEN 'OnRead' THEN status <> 'Failed' WHEN 'AllowStale' THEN status NOT IN ('Failed', 'Deprecated')
  ELSE status IN ('Ready', 'Dirty') END AS usable
FROM (SELECT unnest(['Ready', 'Dirty', 'Pending', 'Failed', 'Stale', 'Deprecated', 'Missing']) AS status), (SELECT unnest(['Strict', 'Lazy', 'AllowDirty', 'OnRead', 'AllowStale']) AS mode)""")
def feature_usability_matrix(spark, sf):
    pairs = [(s, m) for s in values.FEATURE_STATUSES for m in values.FEATURE_MODES]
    return spark.createDataFrame(pairs, "status string, mode string").withColumn("usable", values.usable(F.col("status"), F.col("mode")))


@query(_docs("SELECT record_id, 'GenerateEmbedding' AS kind, 'embedding:' || record_id || ':' || sha256(text) AS idempotency_key, 'Pending' AS next_status FROM docs WHERE status = 'Dirty'"))
def feature_recompute_queue(spark, sf):
    rows = b.docs(spark, sf).select(F.lit("embedding").alias("feature_id"), "record_id", F.sha2("text", 256).alias("source_hash"), F.col("feature_status")["embedding"].alias("status"))
    return operations.recompute_queue(rows)


# Jobs and other operational folds.

#: One job per user and event type: enqueued, then leased and failed by turns as its events come.
_JOBS = """
j AS (
  SELECT user_id * 10 + CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS job_id, event_id, value,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events
),
folded AS (
  SELECT job_id, count(*) FILTER (n > 1 AND n % 2 = 0) AS attempts, max(n) AS n, arg_max(event_id, n) FILTER (n > 1) + 1000 AS last_at, arg_max(event_id % 7 = 0, n) FILTER (n > 1 AND n % 2 = 1) AS permanent FROM j GROUP BY job_id
),
jobs AS (
  SELECT job_id, attempts, CASE WHEN n = 1 THEN 'Queued' WHEN n % 2 = 0 THEN 'Leased' WHEN permanent THEN 'FailedPermanent' WHEN attempts >= 3 THEN 'DeadLettered' ELSE 'FailedRetryable' END AS status,
         CASE WHEN n > 1 AND n % 2 = 0 THEN last_at END AS lease_until, CASE WHEN n > 1 AND n % 2 = 1 THEN last_at END AS not_before FROM folded
)"""


def _jobs(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    kinds = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    rows = b.table(spark, sf, "events").withColumn("job_id", F.col("user_id") * 10 + kinds).withColumn("n", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")))
    leased, failed = F.col("n") % 2 == 0, (F.col("n") > 1) & (F.col("n") % 2 == 1)
    events = rows.select(
        "job_id", F.col("event_id").alias("seq"), F.when(F.col("n") == 1, "enqueued").when(leased, "leased").otherwise("failed").alias("kind"),
        F.when(leased, F.col("event_id") + 1000).alias("lease_until"), F.when(failed, F.col("event_id") + 1000).alias("not_before"), F.when(failed, F.col("event_id") % 7 == 0).alias("permanent"),
    )
    return operations.final_job_states(events)


@query(f"WITH {_JOBS}\nSELECT job_id, attempts, status FROM jobs")
def job_final_status(spark, sf):
    return _jobs(spark, sf).select("job_id", "attempts", "status")


@query("SELECT unnest(['Succeeded', 'DeadLettered', 'FailedPermanent', 'Queued']) AS status, CAST(unnest([1, 1, 1, 1]) AS BIGINT) AS n")
def job_queue_fold(spark, sf):
    """A queue's own log, written by its calls and folded by Spark: one job of each ending."""
    queue = Queue(storage.Store(spark, _folder(spark, "jobs")))
    for key in "abcd":
        queue.enqueue("GenerateEmbedding", key, key)
    for now in (0, 1, 2):
        job = queue.lease_next("w", "GenerateEmbedding", now)
        queue.heartbeat(job.job_id, job.lease_token, now)
        queue.fail(job.job_id, job.lease_token, "late")
    done = queue.lease_next("w", "GenerateEmbedding", 3)
    queue.complete(done.job_id, done.lease_token)
    bad = queue.lease_next("w", "GenerateEmbedding", 4)
    queue.fail(bad.job_id, bad.lease_token, "wrong", permanent=True)
    return operations.status_counts(operations.final_job_states(queue.events()))


@query(f"WITH {_JOBS}\nSELECT status, count(*) AS n FROM jobs GROUP BY status")
def job_status_counts(spark, sf):
    return operations.status_counts(_jobs(spark, sf))


@query(f"WITH {_JOBS}\nSELECT job_id, coalesce(status = 'Queued' OR (status = 'FailedRetryable' AND (not_before IS NULL OR not_before <= 9000)) OR (status = 'Leased' AND lease_until <= 9000), false) AS leasable FROM jobs")
def job_leasable(spark, sf):
    return _jobs(spark, sf).select("job_id", values.leasable(F.col("status"), F.col("lease_until"), F.col("not_before"), F.lit(9000)).alias("leasable"))


_IDEMPOTENT = """
WITH f AS (SELECT user_id, event_type, min(event_id) AS first_id, arg_min(props, event_id) AS first_props FROM events GROUP BY user_id, event_type)
SELECT event_id, CASE WHEN event_id = first_id THEN 'executed' WHEN props IS NOT DISTINCT FROM first_props THEN 'replayed' ELSE 'conflict' END AS outcome
FROM events JOIN f USING (user_id, event_type)"""


def _outcomes(spark, sf):
    rows = b.table(spark, sf, "events").select("user_id", "event_type", "event_id", "props")
    return operations.idempotent(rows, ["user_id", "event_type"], "event_id", "props").select("event_id", "outcome")


@query(f"SELECT * FROM ({_IDEMPOTENT}) WHERE outcome <> 'conflict'")
def idempotent_replay(spark, sf):
    return _outcomes(spark, sf).where("outcome <> 'conflict'")


@query(f"SELECT * FROM ({_IDEMPOTENT}) WHERE outcome = 'conflict'")
def idempotency_conflicts(spark, sf):
    return _outcomes(spark, sf).where("outcome = 'conflict'")


@query("SELECT branch, key, first_id, row_number() OVER (PARTITION BY branch ORDER BY first_id) AS epoch FROM (SELECT user_id % 5 AS branch, event_type || ':' || CAST(user_id AS VARCHAR) AS key, min(event_id) AS first_id FROM events GROUP BY 1, 2)")
def branch_commit_epochs(spark, sf):
    rows = b.table(spark, sf, "events").select((F.col("user_id") % 5).alias("branch"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("first_id"))
    return operations.branch_epochs(rows, "branch", "key", "first_id")


@query("SELECT event_type AS kind, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS units FROM events GROUP BY event_type")
def usage_totals(spark, sf):
    return operations.usage_totals(b.table(spark, sf, "events").withColumn("units", F.floor("value").cast("long")), "event_type", "units")


@query(_docs("SELECT 'docs' AS table_set, array_to_string(list_sort(list(DISTINCT tenant_id)), ',') AS tenant_set FROM docs"))
def segment_table_tenant_sets(spark, sf):
    sets = storage.segment_sets(b.docs(spark, sf).select(F.lit("docs").alias("table"), "tenant_id"))
    return sets.select(*[F.array_join(c, ",").alias(c) for c in sets.columns])


@query("SELECT user_id AS record_id, max(CASE WHEN event_type = 'error' THEN 1.0e0 ELSE 0.0e0 END) AS penalty FROM events GROUP BY user_id")
def suppression_penalty(spark, sf):
    rows = b.table(spark, sf, "events").withColumn("mode", F.when(F.col("event_type") == "error", "Suppress").otherwise("Recall"))
    return operations.suppression(rows, "user_id", "mode")


@query("SELECT user_id AS record_id, round(sum(greatest(value - 50, 0)), 4) AS level, count(*) AS count FROM events GROUP BY user_id")
def activation_level(spark, sf):
    rows = b.table(spark, sf, "events").withColumn("amount", F.col("value") - 50)
    return operations.activation(rows, "user_id", "amount").withColumn("level", F.round("level", 4))
