"""The hybrid query: a lazy plan from a query, its explanation, and pages."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.cursor import Scope, Signer, State, advance, begin, digest
from loomstone.functions import policy as policy_fn
from loomstone.functions import predicates
from loomstone.model import Actor, Freshness, HybridQuery, TableSpec
from loomstone.operators import fusion, scans, streams
from loomstone.operators.versions import visible_at

#: Visible rows up to which a vector query is labelled exact.
EXACT_ROWS = 32
SCORES = ["vector", "lexical", "relational", "freshness_penalty", "final_score"]


@dataclass
class Page:
    """Rows of one page in order, and the cursor of the next."""

    rows: list
    next_cursor: str | None
    explain: Explain | None = None


@dataclass
class StreamExplain:
    """What one candidate stream did."""

    stream: str
    candidates: int
    budget: int
    exhausted: bool


@dataclass
class Explain:
    """Why a query returned what it did."""

    strategy: str
    read_epoch: int
    tenant_visible: int
    policy_visible: int
    scalar_visible: int
    predicates: list[str]
    candidates: dict[str, int]
    deduplicated: int
    checked: int
    removed: int
    returned: int
    features: dict[str, int] = field(default_factory=dict)
    physical_plan: str = ""
    schema_epoch: int = -1
    policy_epoch: int = -1
    scalar_filter_applied: bool = False
    scalar_removed: int = 0
    opened_streams: list[str] = field(default_factory=list)
    skipped_streams: list[str] = field(default_factory=list)
    streams: list[StreamExplain] = field(default_factory=list)
    budget: int = 0
    text_candidates: int = 0
    vector_candidates: int = 0
    hot_overlay_searched: bool = True
    freshness_mode: str = "Strict"
    dirty_features: int = 0
    pending_features: int = 0
    failed_features: int = 0
    missing_features: int = 0
    fusion_method: str = "ReciprocalRankFusion"
    materialized: int = 0
    segments_scanned: int = 0
    module_versions: list[str] = field(default_factory=list)
    exact_fallback: bool = False
    early_stop: str | None = None
    indexed_documents: int = 0
    scored_documents: int = 0
    phase_seconds: dict[str, float] = field(default_factory=dict)


def strategy(query: HybridQuery, visible_rows: int) -> str:
    """A label for explanations; it never changes execution."""
    if query.vector is not None and visible_rows <= EXACT_ROWS:
        return "PolicyPartitionFirst"
    if query.vector is not None:
        return "HybridRecall" if query.has_text else "VectorFirst"
    return "TextFirst" if query.has_text else "RelationalFirst"


class Table:
    """A versioned DataFrame and its spec, with the operations that read it.

    ``rows`` has ``record_id, tenant_id, version_id, begin_epoch, end_epoch,
    tombstone``, the columns of the spec and, where used, ``policy`` (struct or
    null), ``feature_status`` (map by vector column), ``edges``, ``valid_from``
    and ``valid_to``.
    """

    #: Published segments that the rows come from, for explanations.
    segments = 0

    def __init__(self, rows: DataFrame, spec: TableSpec, epoch: int | None = None, providers: Sequence[streams.StreamProvider] = (), signer: Signer | None = None):
        self.rows, self.spec, self.epoch, self.providers, self.signer = rows, spec.validate(), epoch, list(providers), signer

    def at(self, epoch: int) -> Table:
        """The same table as a reader of ``epoch`` sees it."""
        return Table(self.rows, self.spec, epoch, self.providers, self.signer)

    def latest(self) -> int:
        """The epoch of the newest change in the rows."""
        return self.rows.agg(F.coalesce(F.max(F.greatest("begin_epoch", "end_epoch")), F.lit(0))).first()[0]

    def _resumed(self, scope: Scope, cursor: str | None) -> tuple[Table, State]:
        """The table at the snapshot of a signed cursor, and where that cursor continues; a first page binds the newest epoch."""
        if cursor is not None:
            state = self.signer.open(cursor, scope)
        else:
            state = begin(scope, self.epoch if self.epoch is not None else self.latest(), lifetime=self.signer.lifetime)
        return (self if self.epoch == state.epoch else self.at(state.epoch)), state

    def snapshot(self) -> DataFrame:
        """Visible rows of all tenants."""
        if self.epoch is not None:
            return visible_at(self.rows, self.epoch)
        return self.rows.where(F.col("end_epoch").isNull() & F.col("tombstone").isNull())

    def get(self, tenant_id: str, record_id: str) -> DataFrame:
        return scans.get(self.snapshot(), tenant_id, record_id)

    def scan(self, tenant_id: str, limit: int = 100, cursor: str | None = None, actor: Actor | None = None) -> DataFrame:
        """One page of a tenant. With a signer, cursors are signed and every page is of the snapshot of the first."""
        actor = (actor or Actor(tenant_id)).for_tenant(tenant_id)
        if self.signer is None:
            return scans.page(self.snapshot(), tenant_id, limit, cursor)
        scope = self.signer.scope("scan", tenant_id, actor, digest({"table": self.spec.name}), limit, "record_id")
        table, state = self._resumed(scope, cursor)
        rows = scans.page(table.snapshot(), tenant_id, limit, str(state.offset))
        following = self.signer.seal(advance(state, max(1, limit)))
        return rows.withColumn("next_cursor", F.when(F.col("next_cursor").isNotNull(), F.lit(following)))

    def view(self, query: HybridQuery, actor: Actor | None = None) -> DataFrame:
        """Rows that the query may consider: visible, allowed, and equal in every filtered scalar."""
        actor = (actor or Actor(query.tenant_id)).for_tenant(query.tenant_id)
        rows = scans.tenant(self.snapshot(), query.tenant_id)
        if "policy" in rows.columns:
            rows = rows.where(policy_fn.visible(F.col("policy"), actor))
        return predicates.scalar_eq(rows, self.spec, query.scalar_eq)

    def streams(self, query: HybridQuery, view: DataFrame, budget: int) -> dict[str, DataFrame]:
        """The evidence streams that the query opens, its own from one pass over the view."""
        return self._streams(query, view, streams.narrow(view, self.spec, query), budget)

    def _streams(self, query: HybridQuery, view: DataFrame, rows: DataFrame, budget: int) -> dict[str, DataFrame]:
        out = streams.opened(rows, query, budget)
        for provider in self.providers:
            opened = provider.open(view, self.spec, query, budget)
            if opened is not None:
                out[provider.name] = opened
        return out

    def check(self, query: HybridQuery) -> None:
        """Raises for fields the table lacks and for a vector of another length."""
        if query.text is not None:
            self.spec.text_columns(query.text_field)
        if query.vector is not None:
            v = self.spec.vector(query.vector_field)
            if len(query.vector) != v.dimensions:
                from loomstone.errors import DimensionMismatch

                raise DimensionMismatch(f"vector field {v.name!r} has {v.dimensions} dimensions; the query has {len(query.vector)}")

    def candidates(self, query: HybridQuery, view: DataFrame, offset: int) -> DataFrame:
        """Fused candidates with their position; bounded by the budget."""
        budget = query.budget(offset)
        rows = streams.narrow(view, self.spec, query)
        opened = self._streams(query, view, rows, budget)
        fused = fusion.fuse_with_fallback(opened, streams.first_rows(rows, budget))
        return fusion.positioned(fused, query.text is not None, query.vector is not None)

    def plan(self, query: HybridQuery, actor: Actor | None = None, offset: int = 0) -> DataFrame:
        """One page as a lazy DataFrame: the table's columns, scores, and ``position`` from 1.

        Candidates carry ids and scores only; the few that make the page are
        broadcast to fetch their rows, so wide columns are read for them alone.
        """
        self.check(query)
        view = self.view(query, actor)
        if query.top_k == 0:
            view = view.where("false")
        ranked = self.candidates(query, view, offset)
        page = ranked.where((F.col("position") > offset) & (F.col("position") <= offset + query.top_k))
        scored = page.select(
            "record_id", "position", "vector", "lexical", "relational", F.col("penalty").alias("freshness_penalty"), F.col("final").alias("final_score")
        )
        columns = ["version_id", "tenant_id", *self.spec.scalars, *self.spec.texts]
        return view.join(F.broadcast(scored), "record_id").select("record_id", *columns, *SCORES, "position")

    def query(self, query: HybridQuery, actor: Actor | None = None) -> Page:
        """A page of rows in order, with the next cursor and, if asked for, the explanation."""
        if query.top_k == 0:
            self.check(query)
            return Page([], None, self.explain(query, actor) if query.explain else None)
        table, state = self, None
        if self.signer is None:
            offset = scans.offset_of(query.cursor)
        else:
            asked = actor or Actor(query.tenant_id)
            told = {k: v for k, v in query.__dict__.items() if k not in ("cursor", "explain")}
            scope = self.signer.scope("query", query.tenant_id, asked, digest(told), query.top_k, "fused")
            table, state = self._resumed(scope, query.cursor)
            offset = state.offset
        more = HybridQuery(**{**query.__dict__, "top_k": query.top_k + 1})
        rows = table.plan(more, actor, offset).orderBy("position").collect()
        cursor = None
        if len(rows) > query.top_k:
            cursor = str(offset + query.top_k) if state is None else self.signer.seal(advance(state, query.top_k))
        return Page(rows[: query.top_k], cursor, table.explain(query, actor, offset) if query.explain else None)

    def explain(self, query: HybridQuery, actor: Actor | None = None, offset: int | None = None) -> Explain:
        """Counters of a query, by small aggregate jobs, and Spark's plan."""
        actor = actor or Actor(query.tenant_id)
        if offset is None:
            offset = scans.offset_of(query.cursor)
        seconds: dict[str, float] = {}
        began = time.perf_counter()

        def phase(name: str) -> None:
            nonlocal began
            now = time.perf_counter()
            seconds[name], began = round(now - began, 6), now

        tenant = scans.tenant(self.snapshot(), query.tenant_id)
        allowed = policy_fn.visible(F.col("policy"), actor) if "policy" in tenant.columns else F.lit(True)
        view = self.view(query, actor)
        totals = tenant.agg(F.count("*").alias("all"), F.count_if(allowed).alias("allowed")).first()
        states = [F.coalesce(F.col("feature_status")[v.name], F.lit("Missing")) for v in self.spec.vectors]
        seen = view.groupBy(F.array(*states).alias("s") if states else F.array().cast("array<string>").alias("s")).count().collect()
        n, features = sum(r["count"] for r in seen), {}
        for r in seen:
            for v, state in zip(self.spec.vectors, r.s, strict=True):
                features[f"{v.name}:{state}"] = features.get(f"{v.name}:{state}", 0) + r["count"]
        phase("visible")
        budget = query.budget(offset)
        opened = self.streams(query, view, budget) if query.top_k else {}
        counts = {name: s.count() for name, s in opened.items()}
        counts["fallback"] = min(n, budget) if query.top_k else 0
        phase("streams")
        ranked = self.candidates(query, view, offset) if query.top_k else None
        guard = fusion.guard_counts(ranked, view).first() if ranked is not None else None
        checked, removed = (guard.checked, guard.removed) if guard else (0, 0)
        phase("fusion")
        plan = self.plan(query, actor, offset)
        returned = min(max(0, checked - removed - offset), query.top_k)
        count = lambda state: sum(c for k, c in features.items() if k.endswith(f":{state}"))
        names = [*fusion.STREAMS, *[p.name for p in self.providers]]
        label = strategy(query, n)
        text = plan._jdf.queryExecution().explainString(plan.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        phase("plan")
        epoch = self.epoch if self.epoch is not None else -1
        return Explain(
            label, epoch, totals["all"], totals.allowed, n, predicates.labels(query.scalar_eq), counts, checked, checked, removed, returned, features, text,
            schema_epoch=self.latest(), policy_epoch=epoch, scalar_filter_applied=bool(query.scalar_eq), scalar_removed=totals.allowed - n,
            opened_streams=[*opened, "policy", "relational", "hot_overlay"] if query.top_k else [], skipped_streams=[x for x in names if x not in opened],
            streams=[StreamExplain(name, c, budget, c < budget) for name, c in counts.items()], budget=budget if query.top_k else 0,
            text_candidates=counts.get("lexical", 0), vector_candidates=counts.get("vector", 0), freshness_mode=str(query.freshness),
            dirty_features=count("Dirty"), pending_features=count("Pending"), failed_features=count("Failed"), missing_features=count("Missing"),
            materialized=min(max(0, checked - removed), offset + query.top_k + 1), segments_scanned=self.segments, module_versions=[f"{p.name}:{getattr(p, 'version', '0')}" for p in self.providers],
            exact_fallback=query.vector is not None and n <= EXACT_ROWS, early_stop=None if query.top_k else "top_k is 0",
            indexed_documents=n if query.has_text else 0, scored_documents=counts.get("lexical", 0), phase_seconds=seconds,
        )


def default_freshness(name: str) -> Freshness:
    """A freshness mode by any of its spellings."""
    key = name.replace("_", "").replace("-", "").lower()
    return {"strict": Freshness.STRICT, "lazy": Freshness.LAZY, "allowdirty": Freshness.ALLOW_DIRTY}[key]
