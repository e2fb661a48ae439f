"""DuckDB SQL of the hybrid query."""

from __future__ import annotations

from collections.abc import Sequence

from loomstone.functions.text import query_terms
from loomstone.plans.bindings import DOCS_SQL

TOKENS = "list_transform(regexp_extract_all({text}, '[A-Za-z0-9]+'), lambda x: lower(x))"


def visible(tenant: str, user: str = "legacy-query") -> str:
    """The policy filter of an actor."""
    return f"tenant_id = '{tenant}' AND visibility <> 'Hidden' AND NOT (visibility = 'Acl' AND allowed <> '{user}') AND NOT suppressed"


def bm25(source: str, text: str, query: str) -> str:
    """CTEs ``cnt``, ``st`` and ``scored(record_id, score)`` over ``source``."""
    terms = query_terms(query)
    distinct = list(dict.fromkeys(terms))
    tf = ", ".join(f"len(list_filter(toks, lambda t: t = '{t}')) AS tf{i}" for i, t in enumerate(distinct))
    df = ", ".join(f"CAST(sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS df{i}" for i in range(len(distinct)))

    def term(i: int) -> str:
        return f"CASE WHEN tf{i} > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.5e0 / (tf{i} + 1.5e0 * (0.25e0 + 0.75e0 * dl / greatest(avgdl, 1.0e0))) ELSE 0 END"

    total = " + ".join(term(distinct.index(t)) for t in terms)
    return f"""
tok AS (SELECT record_id, {TOKENS.format(text=text)} AS toks FROM {source}),
cnt AS (SELECT record_id, CAST(len(toks) AS DOUBLE) AS dl, {tf} FROM tok),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {df} FROM cnt),
scored AS (SELECT record_id, round({total}, 6) AS score FROM cnt, st WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(distinct)))})"""


def cosine(column: str = "embedding") -> str:
    return f"list_cosine_similarity(CAST({column} AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


def vector_cte(source: str, allow_dirty: bool) -> str:
    """CTE ``vscored(record_id, score, penalty)`` over ``source``."""
    dirty = "WHEN status = 'Dirty' THEN 0.05" if allow_dirty else ""
    return f"""
vscored AS (
  SELECT record_id, round(round({cosine()}, 6) - penalty, 6) AS score, penalty
  FROM (SELECT *, CAST(CASE WHEN status = 'Ready' THEN 0.0 {dirty} END AS DOUBLE) AS penalty FROM {source}) WHERE penalty IS NOT NULL AND embedding IS NOT NULL
)"""


def ranked(name: str, source: str, score: str, penalty: str, budget: int, where: str = "true") -> str:
    return f"""
{name} AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, record_id) AS rank
  FROM (SELECT record_id, {score} AS score, {penalty} AS penalty FROM {source} WHERE {where} ORDER BY score DESC, record_id LIMIT {budget})
)"""


def hybrid(tenant: str, text: str | None = None, vector: bool = False, allow_dirty: bool = False, graph: str | None = None, at: int | None = None, top_k: int = 10, offset: int = 0, where: str = "true", text_expr: str = "coalesce(text, '')") -> str:
    """The whole hybrid query; columns as the engine's plan gives them."""
    budget = 4 * (offset + top_k + 1)
    ctes = [DOCS_SQL, f"v AS (SELECT * FROM docs WHERE {visible(tenant)} AND {where})"]
    opened = []
    if text is not None:
        ctes += [bm25("v", text_expr, text), ranked("lexical", "scored", "score", "0.0", budget, "score > 0")]
        opened.append("lexical")
    if vector:
        ctes += [vector_cte("v", allow_dirty), ranked("vector", "vscored", "score", "penalty", budget)]
        opened.append("vector")
    if graph is not None:
        ctes.append(ranked("graph", "v", "0.6", "0.0", budget, f"list_contains(edges, '{graph}')"))
        opened.append("graph")
    if at is not None:
        ctes.append(ranked("temporal", "v", "0.65", "0.0", budget, f"valid_from <= {at} AND {at} <= valid_to"))
        opened.append("temporal")
    ctes.append(ranked("fallback", "v", "1.0", "0.0", budget))
    null = "CAST(NULL AS DOUBLE)"
    if opened:
        union = " UNION ALL ".join(f"SELECT record_id, '{s}' AS stream, CAST(score AS DOUBLE) AS score, CAST(penalty AS DOUBLE) AS penalty, rank FROM {s}" for s in opened)
        picked = ", ".join(f"max(CASE WHEN stream = '{s}' THEN score END) AS {s}, max(CASE WHEN stream = '{s}' THEN rank END) AS {s}_rank" for s in opened)
        total = " + ".join(f"coalesce(1.0e0 / (60 + {s}_rank), 0)" for s in opened)
        column = {s: (s if s in opened else null) for s in ("lexical", "vector", "graph", "temporal")}
        ctes.append(f"grouped AS (SELECT record_id, {picked}, max(penalty) AS penalty FROM ({union}) GROUP BY record_id)")
        ctes.append(
            f"evidence AS (SELECT record_id, {column['lexical']} AS lexical, {column['vector']} AS vector, penalty, {total} - penalty AS final, "
            f"CAST(coalesce({column['temporal']}, {column['graph']}) AS DOUBLE) AS relational, 0 AS tier FROM grouped)"
        )
    else:
        ctes.append(f"evidence AS (SELECT '' AS record_id, {null} AS lexical, {null} AS vector, 0.0 AS penalty, 0.0 AS final, {null} AS relational, 0 AS tier WHERE false)")
    ctes.append(
        f"fused AS (SELECT * FROM evidence UNION ALL SELECT record_id, {null}, {null}, 0.0, 1.0e0 / (60 + rank) + 1.0e0 / (60 + rank) + 1.0e0 / (60 + rank), 1.0, 1 "
        "FROM fallback WHERE record_id NOT IN (SELECT record_id FROM evidence))"
    )
    untied = "coalesce(max(lexical) OVER () - min(lexical) OVER () > 1e-6, false)" if text is not None else "false"
    ctes.append(f"moded AS (SELECT *, CASE WHEN {untied} THEN 'lexical' WHEN {str(vector).lower()} THEN 'vector' ELSE 'tier' END AS mode FROM fused)")
    ctes.append(
        "placed AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN mode = 'lexical' THEN lexical END DESC NULLS LAST, "
        "CASE WHEN mode = 'vector' OR (mode = 'lexical' AND lexical IS NOT NULL) THEN vector END DESC NULLS LAST, "
        "CASE WHEN mode = 'tier' THEN tier END ASC NULLS LAST, final DESC, record_id) AS position FROM moded)"
    )
    return (
        "WITH " + ",".join(ctes) + "\nSELECT p.record_id, v.version_id, v.tenant_id, v.source, v.n_chars, p.vector, p.lexical, p.relational, "
        f"CAST(p.penalty AS DOUBLE) AS freshness_penalty, round(p.final, 9) AS final_score, p.position FROM placed p JOIN v USING (record_id) WHERE position > {offset} AND position <= {offset + top_k}"
    )


def terms_sql(terms: Sequence[str]) -> str:
    return ", ".join(f"('{t}')" for t in terms)
