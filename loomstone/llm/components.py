"""Connected components of links found through shared keys, without all pairs of a key.

Members of a key are compared with one leader first. Keys whose members are all
in one component by then are done; in the others, only members of different
components are compared. No link is lost: two members of a key that were never
compared are in one component already.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.scratch import cut, freeing


@dataclass
class Links:
    """``members``: ``id long, key long`` and, if only some pairs of a key count, ``wide``: one side must be wide.

    ``verify`` takes distinct pairs ``a < b`` and returns those that link.
    ``sketches`` takes ids and returns ``id`` with further columns; ``possible``
    is a condition on two members and their sketches, prefixed ``x_`` and ``y_``,
    that holds for every pair which may still have to be found under a key. Further
    columns of ``members`` are bounds from above: a larger value excludes no pair.
    ``begun``, in place of ``members``, is a first round that is done: ``id, key,
    leader`` of the keys with more than two members, the pairs ``a < b`` that
    were compared (each member of each key with the key's leader), and those
    that link.
    """

    members: DataFrame | None
    verify: Callable[[DataFrame], DataFrame]
    sketches: Callable[[DataFrame], DataFrame] | None = None
    possible: str = "true"
    begun: tuple[DataFrame, DataFrame, DataFrame] | None = None


#: Members of a key with which all others are compared in the second round.
LEADERS = 4
#: Members of a key that one task pairs with the others in the last round.
BLOCK = 4096


#: Edges of which one task makes a forest.
PART = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges that are not their component's smallest, and that smallest one: a star for each component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:  # each node points to its root
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        a, b = root[a], root[b]
        left = a != b
        a, b = a[left], b[left]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _stars(part: pa.Table) -> pa.Table:
    u, v = forest(part.column("u").to_numpy(), part.column("v").to_numpy())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def connected(edges: DataFrame) -> DataFrame:
    """``id, label`` of every node of ``edges(a, b)``: label is its component's smallest id.

    Union-find in two levels. Edges are dealt into parts of about ``PART``, and
    one task turns each part into stars, a star for each component that the part
    knows of. One part is the whole result. The stars of several parts are joined
    by alternating large and small stars, a logarithmic number of rounds in the
    usual case. A node of any degree is only ever a group's key with a combined
    minimum and one side of a join whose skew Spark may split.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    parts = -(-e.count() // PART)
    dealt = e.withColumn("part", F.pmod(F.xxhash64("u", "v"), F.lit(max(1, parts))))
    e = cut(dealt.groupBy("part").applyInArrow(freeing(_stars), "u long, v long"))
    before = None
    while parts > 1:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` after further edges ``a, b``: only the components that these join are looked at again."""
    known = cut(labels)
    at = known.withColumnRenamed("label", "l")
    mapped = more.join(at.withColumnRenamed("id", "a").withColumnRenamed("l", "la"), "a", "left").join(at.withColumnRenamed("id", "b").withColumnRenamed("l", "lb"), "b", "left")
    ends = cut(mapped.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")))
    joined = connected(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("id").alias("label"), F.col("label").alias("to"))
    new = ends.select(F.col("a").alias("id"), F.col("la").alias("label")).unionByName(ends.select(F.col("b").alias("id"), F.col("lb").alias("label"))).where("id = label").distinct()
    every = known.unionByName(new.join(known.select("id"), "id", "left_anti"))
    return every.join(joined, "label", "left").select("id", F.coalesce("to", "label").alias("label"))


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _prefixed(rows: DataFrame, prefix: str, columns: list[str], more: list) -> DataFrame:
    return rows.select(*more, *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def _first_round(members: DataFrame) -> tuple[DataFrame, list[str], DataFrame]:
    """Keys of more than two members with their leader, the members' own columns, and the pairs with leaders.

    Leaders come from a count that Spark combines before it shuffles and a join
    whose skew it may split: no key goes through one task.
    """
    members = cut(members if "wide" in members.columns else members.withColumn("wide", F.lit(True)))  # read twice
    own = [c for c in members.columns if c not in ("id", "key")]
    keys = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("wide"), F.col("id"))).alias("leader")).where("n > 1 and leader is not null")
    lists = cut(members.join(keys, "key"))
    seen = cut(_pairs(lists.where("id <> leader"), "id", "leader"))
    return lists.where("n > 2").drop("n"), own, seen


def _by_leader(open_keys: DataFrame, own: list[str]) -> DataFrame:
    """``open_keys`` with one key in place of those of one leader where that leaves fewer pairs.

    Near copies meet under many keys that hold almost the same members, and each
    of these keys would pair them again. The one key holds all members of the
    others, so no pair is lost; a member takes its largest ``own`` values. All of
    them were compared with the leader already.
    """
    heads = open_keys.groupBy("key").agg(F.max(F.when(F.col("id") == F.col("leader"), F.col("label"))).alias("head")).where("head is not null")
    rows = cut(open_keys.join(heads, "key"))
    x, y = F.count_if(F.col("label") != F.col("head")), F.count_if(F.col("id") != F.col("leader"))
    keys = cut(rows.groupBy("key", "leader").agg((x * y).alias("pairs")))
    apart = keys.groupBy("leader").agg(F.sum("pairs").alias("apart"), F.min("key").alias("one"), F.count("*").alias("keys"))
    together = rows.select("leader", "head", "id", "label").distinct().groupBy("leader").agg((x * y).alias("together"))
    joined = apart.where("keys > 1").join(together, "leader").where("together < apart").select("leader", "one")
    # By key, not by leader: one leader may have a large part of all rows.
    keyed = rows.join(keys.join(joined, "leader").select("key", "one"), "key", "left").withColumn("key", F.coalesce("one", "key"))
    return keyed.groupBy("key", "leader", "id", "label").agg(*[F.max(c).alias(c) for c in own])


def components(links: Links) -> DataFrame:
    """``id, label`` of every id that links to another one.

    First round: each key's smallest member with the others. Second round: in
    keys that still hold several components, a few more members with all those
    of other components. Last: in keys that are still divided, the pairs of
    different components that the sketches leave possible; unless the first round
    was done before, keys of one leader are one key there if they hold much the same.
    """
    if links.begun is not None:
        lists, seen, found = links.begun
        lists, own, found = cut(lists.withColumn("wide", F.lit(True))), ["wide"], cut(found)
    else:
        lists, own, seen = _first_round(links.members)
        found = cut(links.verify(seen))
    labels = cut(connected(found))

    def divided(among: DataFrame, labels: DataFrame) -> DataFrame:
        """Members, with their labels, of those keys among the given ones that hold several components."""
        rows = cut(among.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
        split = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        return cut(rows.join(split, "key"))

    open_keys = divided(lists, labels)
    order = Window.partitionBy("key").orderBy(F.xxhash64("id", F.lit(1)), "id")
    few = open_keys.withColumn("n", F.row_number().over(order)).where(F.col("n") <= LEADERS)
    columns = ["id", "label", *own]
    tried = _prefixed(open_keys, "x", columns, ["key"]).join(_prefixed(few, "y", columns, ["key"]), "key")
    tried = tried.where("x_label <> y_label and (x_wide or y_wide)")
    again = cut(_pairs(tried, "x_id", "y_id").join(seen, ["a", "b"], "left_anti"))
    more = cut(links.verify(again))
    seen = seen.unionByName(again)
    if not more.isEmpty():
        labels = cut(merged(labels, more))
        open_keys = divided(open_keys.drop("label"), labels)  # a key that holds one component will not hold several
    if links.begun is None:
        open_keys = cut(_by_leader(open_keys, own))
    heads = open_keys.groupBy("key").agg(F.max(F.when(F.col("id") == F.col("leader"), F.col("label"))).alias("head"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("head is not null")
    rows = open_keys.join(heads, "key")
    if links.sketches is not None:
        rows = rows.join(links.sketches(open_keys.select("id").distinct()), "id")
    rows = cut(rows)
    # A key with many members is many pairs of blocks: one side is dealt into them, the other is in each.
    columns = [c for c in rows.columns if c not in ("key", "blocks")]
    x = _prefixed(rows.where("label <> head"), "x", columns, ["key", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")])
    y = _prefixed(rows.where("id <> leader"), "y", columns, ["key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")])
    crossed = x.join(y, ["key", "block"]).where(f"x_label <> y_label and (y_label = y_head or x_id < y_id) and (x_wide or y_wide) and ({links.possible})")
    last = cut(links.verify(_pairs(crossed, "x_id", "y_id").join(seen, ["a", "b"], "left_anti")))
    return labels if last.isEmpty() else cut(merged(labels, last))
