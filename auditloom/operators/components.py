"""Strongly connected components of any number of graphs at once, as joins over an edge table.

Each node carries two labels, the smallest node that reaches it and the smallest that it reaches, itself included. Labels spread
along all edges in a round, and jump: a label's own label holds for the node too, so that long chains take a number of
rounds near the logarithm of their length. Where both labels agree, the node shares the component of that label's node;
no component has nodes with different labels. So edges between different labels go, as do nodes without an edge in or out,
and the rest is labelled again. No graph is ever in one task.

State is a table of nodes (three numbers each) and one of edges (two numbers each), written in the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import Rounds


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges that can lie on a cycle: something enters their source and something leaves their target."""
    out = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return out.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")


def labels(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """id, before (smallest node that reaches it), after (smallest node that it reaches) of all nodes of the edges."""
    now, _ = rounds.write(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("before"), F.col("id").alias("after"), F.lit(True).alias("moved")))
    way = lambda df, tells, told, forward, jump=False: df.select(F.col(tells).alias("tells"), F.col(told).alias("id"), F.lit(forward).alias("forward"), F.lit(jump).alias("jump"))
    arcs = way(edges, "a", "b", True).unionByName(way(edges, "b", "a", False))
    none = F.lit(None).cast("long")
    while True:
        # along edges from nodes that moved in the last round, and from a node's own labels, new or old
        ways = arcs.unionByName(way(now, "before", "id", True, True)).unionByName(way(now, "after", "id", False, True))
        told = ways.join(now.select(F.col("id").alias("tells"), "before", "after", "moved"), "tells").where("jump or moved")
        heard = told.select("id", F.when(F.col("forward"), F.col("before")).alias("before"), F.when(~F.col("forward"), F.col("after")).alias("after"), none.alias("was_before"), none.alias("was_after"))
        every = heard.unionByName(now.select("id", "before", "after", F.col("before").alias("was_before"), F.col("after").alias("was_after")))
        best = every.groupBy("id").agg(*(F.min(c).alias(c) for c in ("before", "after", "was_before", "was_after")))
        step = best.select("id", "before", "after", ((F.col("before") < F.col("was_before")) | (F.col("after") < F.col("was_after"))).alias("moved"))
        now, seen = rounds.write(step, {"changed": F.count_if("moved")})
        if not seen["changed"]:
            return now.drop("moved")


def components(edges: DataFrame) -> DataFrame:
    """edges: project_id, src, dst -> project_id, component, node: the nodes of every component of two or more, and nodes that
    point at themselves. A component is named by its first node in order."""
    rounds = Rounds(edges.sparkSession, "components")
    edges, _ = rounds.write(edges.select("project_id", "src", "dst").distinct())
    loops = edges.where("src = dst").select("project_id", F.col("src").alias("node"))
    plain = edges.where("src <> dst")
    # a number for each node that may lie on a cycle, fixed by being written
    ends = plain.select("project_id", F.col("src").alias("node")).intersect(plain.select("project_id", F.col("dst").alias("node")))
    names, seen = rounds.write(ends.select(F.monotonically_increasing_id().alias("id"), "project_id", "node"))
    if not seen["rows"]:
        return loops.select("project_id", F.col("node").alias("component"), "node")
    of = lambda end, number: names.select("project_id", F.col("node").alias(end), F.col("id").alias(number))
    left = plain.join(of("src", "a"), ["project_id", "src"]).join(of("dst", "b"), ["project_id", "dst"]).select("a", "b")
    found = None
    while True:
        left, seen = rounds.write(trimmed(left))
        if not seen["rows"]:
            break
        at = labels(left, rounds)
        whole = at.where(F.col("before") == F.col("after")).select("id", F.col("before").alias("root"))
        found = whole if found is None else found.unionByName(whole)
        a, b = (at.select(F.col("id").alias(c), F.col("before").alias(f"{c}_before"), F.col("after").alias(f"{c}_after")) for c in "ab")
        left = left.join(a, "a").join(b, "b").where("a_before = b_before and a_after = b_after and a_before <> a_after").select("a", "b")
    if found is None:
        return loops.select("project_id", F.col("node").alias("component"), "node")
    sizes = found.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    rows = found.join(sizes, "root").join(names, "id").select("project_id", "root", "node")
    first = rows.groupBy("project_id", "root").agg(F.min("node").alias("component"))
    many = rows.join(first, ["project_id", "root"]).select("project_id", "component", "node")
    alone = loops.join(many.select("project_id", "node"), ["project_id", "node"], "left_anti")
    out, _ = rounds.write(many.unionByName(alone.select("project_id", F.col("node").alias("component"), "node")))
    return out
