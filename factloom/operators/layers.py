"""Layers of a directed graph: strongly connected components by trimming and colouring, and topological layers of what is left.

Every round joins only what the last one has changed with its own edges. Trimming takes away, round by round, nodes without an edge
out and then nodes without an edge in; none of them is in a cycle. What stays is coloured: each node takes the largest name
that reaches it, and the nodes from which a colour's name can be reached within the colour are that name's component. The
components then form a graph without cycles, whose layers are counted by the edges that are left to each node."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import _kept


def _some(df: DataFrame) -> bool:
    return not df.isEmpty()


def peeled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, layer): nodes all of whose successors have a layer, one more than the largest of these; 0 without a successor. Nodes that
    reach a cycle have no row. edges: src, dst, distinct; nodes: node, distinct."""
    left = _kept(edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out")))
    front = _kept(nodes.join(left, "node", "left_anti").withColumn("layer", F.lit(0)))
    done, layer = front, 0
    while _some(front):
        layer += 1
        less = edges.join(front.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("gone"))
        # one table a round: the counts that are left, and those that are used up
        new = _kept(left.join(less, "node", "left").select("node", (F.col("out") - F.coalesce("gone", F.lit(0))).alias("out")))
        front, left = new.filter("out = 0").select("node", F.lit(layer).alias("layer")), new.filter("out > 0")
        done = done.unionByName(front)
        if layer % 16 == 0:
            done = _kept(done)
    return done


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def _coloured(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, colour): the largest node that reaches each."""
    held = _kept(nodes.select("node", F.col("node").alias("colour")))
    front = held
    while _some(front):
        told = edges.join(front, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("colour").alias("new"))
        larger = F.coalesce(F.col("new") > F.col("colour"), F.lit(False))
        new = _kept(held.join(told, held["node"] == told["dst"], "left").select("node", F.when(larger, F.col("new")).otherwise(F.col("colour")).alias("colour"), larger.alias("fresh")))
        front, held = new.filter("fresh").select("node", "colour"), new.select("node", "colour")
    return held


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component, size): strongly connected components of a distinct edge table, named by their largest node."""
    edges = _kept(edges.filter("src <> dst").select("src", "dst").distinct())
    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    down = peeled(edges, nodes)
    core = _kept(nodes.join(down.select("node"), "node", "left_anti"))
    inner = _kept(_within(backward, core))
    core = _kept(core.join(peeled(inner, core).select("node"), "node", "left_anti"))
    found = None
    while _some(core):
        inner = _kept(_within(edges, core))
        colours = _coloured(inner, core)
        # back from each colour's name, within the colour
        same = _kept(inner.join(colours, F.col("src") == F.col("node")).select("src", "dst", F.col("colour").alias("c")).join(colours, F.col("dst") == F.col("node")).filter("c = colour").select("src", "dst"))
        seen = front = _kept(colours.filter("node = colour"))
        for i in itertools.count(1):
            step = same.join(front, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "colour").distinct()
            front = _kept(step.join(seen, "node", "left_anti"))
            if not _some(front):
                break
            seen = seen.unionByName(front) if i % 8 else _kept(seen.unionByName(front))
        found = seen if found is None else found.unionByName(seen)
        core = _kept(core.join(seen, "node", "left_anti"))
    named = nodes.withColumn("component", F.col("node")) if found is None else nodes.join(found, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return named.join(sizes, "component").select("node", "component", "size")


def layers(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component, layer, cyclic: each node's layer, 0 where nothing follows, else one more than the largest layer of a component
    that its own has an edge to. Nodes of a cycle share their component's layer and are cyclic, as is one with an edge to itself."""
    pairs = _kept(edges.select("src", "dst").distinct())
    ends = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node")))
    every = _kept((ends if nodes is None else ends.unionByName(nodes.select("node"))).filter("node is not null").distinct())
    part = _kept(components(pairs, every))
    names = part.select("node", "component")
    between = pairs.join(names.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(names.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    condensed = _kept(between.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    found = peeled(condensed, part.select(F.col("component").alias("node")).distinct()).withColumnRenamed("node", "component")
    own = pairs.filter("src = dst").select(F.col("src").alias("node")).distinct().withColumn("own", F.lit(True))
    return part.join(found, "component").join(own, "node", "left").select("node", "component", "layer", ((F.col("size") > 1) | F.coalesce("own", F.lit(False))).alias("cyclic"))
