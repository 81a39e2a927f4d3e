"""Classes of linked items: connected components, and links found through lists.

``components`` contracts a graph round by round: every node that has a smaller
neighbour hooks onto its smallest one, the trees so made are flattened by pointer
jumping, and the edges between trees go on. Nothing is collected; each round is
written to the shared folder.

``linked_classes`` finds the classes of items that share list keys and pass a
check, without making all pairs of a list. Where the pairs across classes far
outnumber the list entries, one item of each list (its hub) is checked against
the others: copies of one thing fall into its class at once, and pairs within a
class are never made. If long lists remain, of items that are alike but not
enough, the caller may refine them, that is give sharper lists for the items in
them. The pairs across classes that remain are then checked one and all, so no
link between two classes is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import passing, staged


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` of the nodes of ``edges (a, b)``; ``comp`` is the least node."""
    with passing(edges.sparkSession) as keep:
        return keep(_components(edges))


def _components(edges: DataFrame) -> DataFrame:
    rest = staged(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                  .where("hi != lo").distinct(), "edges")
    nodes = rest.select(F.col("hi").alias("node")).union(rest.select("lo")).distinct()
    out = nodes.withColumn("comp", F.col("node"))
    while not rest.isEmpty():
        tree = staged(rest.groupBy(F.col("hi").alias("child")).agg(F.min("lo").alias("parent")), "tree")
        while True:
            above = tree.select(F.col("child").alias("parent"), F.col("parent").alias("next"))
            moved = tree.join(above, "parent", "left")
            tree = staged(moved.select("child", F.coalesce("next", "parent").alias("parent"),
                                       F.col("next").isNotNull().alias("moved")), "tree")
            still = not tree.where("moved").isEmpty()
            tree = tree.select("child", "parent")
            if not still:
                break
        for side in ("hi", "lo"):
            up = tree.select(F.col("child").alias(side), F.col("parent").alias("up"))
            rest = rest.join(up, side, "left").withColumn(side, F.coalesce("up", side)).drop("up")
        rest = staged(rest.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
                      .where("hi != lo").distinct(), "edges")
        up = tree.select(F.col("child").alias("comp"), F.col("parent").alias("up"))
        out = out.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    return staged(out, "components")


def _live(entries: DataFrame, classes: DataFrame | None) -> tuple[DataFrame, int]:
    """Entries of the keys that pairs across classes share, and how many pairs these are."""
    if classes is None:
        rows = entries.withColumn("comp", F.col("node"))
    else:
        rows = entries.join(classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("n"), F.count_if("indexed").alias("i"))
    across = F.sum("n") * F.sum("i") - F.sum(F.col("n") * F.col("i"))
    keys = staged(parts.groupBy("key").agg(across.alias("across")).where("across > 0"), "keys")
    pairs = keys.agg(F.sum("across")).first()[0] or 0
    return staged(rows.join(keys, "key", "left_semi"), "lists"), pairs


def linked_classes(entries: DataFrame, verify: Callable[[DataFrame], DataFrame],
                   compatible: Callable[[Column, Column], Column],
                   refine: Callable[[DataFrame], DataFrame] | None = None,
                   first: Callable[[Column, Column], Column] | None = None,
                   classes: DataFrame | None = None) -> DataFrame:
    """``(node, comp)`` of the nodes that have a link, also by ``classes`` that are known before.

    ``entries (key, node, indexed, trait)``: stored; two nodes are a candidate
    pair if they share a key under which one at least is indexed. ``compatible``
    tells from two traits that a pair may be linked, and never denies a linked
    one. ``verify`` keeps the linked ones of the pairs ``(a, b)``. ``refine``
    gives stored entries for some nodes alone, under which all linked pairs of
    them are candidates again. ``first`` may deny a pair under a key if it is one
    under another key too, which it does not deny there; it only saves rows.
    """
    spark = entries.sparkSession
    most = 4 * entries.count()
    # hubs, refined lists, hubs of these, and at last all pairs; each only if needed
    for step in ("hubs", "refine", "hubs", "pairs"):
        with passing(spark) as keep:
            rows, pairs = _live(entries, classes)
            if pairs > most and step == "refine" and refine is not None:
                entries = keep(refine(rows.select("node").distinct()))
                continue
            last = pairs <= most or step == "pairs"
            indexed = rows.where("indexed").select("key", *[F.col(c).alias(f"{c}_i") for c in ("node", "trait", "comp")])
            if not last:
                order = F.struct(F.xxhash64("node_i", F.lit(step)).alias("order"), "node_i", "trait_i", "comp_i")
                indexed = indexed.groupBy("key").agg(F.min(order).alias("hub")).select("key", "hub.*").drop("order")
            if pairs:
                across = (F.col("comp") != F.col("comp_i")) & compatible(F.col("trait"), F.col("trait_i"))
                if last and first is not None:
                    across = across & first(F.col("trait"), F.col("trait_i"))
                some = (rows.join(indexed, (rows["key"] == indexed["key"]) & across)
                        .select(F.least("node", "node_i").alias("a"), F.greatest("node", "node_i").alias("b")).distinct())
                links = staged(verify(staged(some, "pairs")).select("a", "b"), "links")
                classes = keep(merged(classes, links))
        if last:
            break
    if classes is None:
        classes = staged(entries.select("node", F.col("node").alias("comp")).limit(0), "classes")
    return classes


def merged(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """Classes after further links between nodes."""
    if classes is None:
        return components(links)
    for side in ("a", "b"):
        up = classes.select(F.col("node").alias(side), F.col("comp").alias("up"))
        links = links.join(up, side, "left").withColumn(side, F.coalesce("up", side)).drop("up")
    joined = components(links)
    up = joined.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    old = classes.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    new = joined.join(classes.select("node"), "node", "left_anti")
    return staged(old.unionByName(new), "classes")
