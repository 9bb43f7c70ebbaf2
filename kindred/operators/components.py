"""Connected components of an undirected graph, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import storage


#: Rounds in the order of the nodes themselves, and how often the pointers of such a round are doubled at most.
OWN_ORDER, DOUBLINGS = 2, 3


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Labels each node of ``edges`` (src, dst) with the smallest node that it can reach.

    Each round gives nodes an order, their own in the first rounds, which suits stars
    around small nodes, and then random ones, which shorten chains; it points each node to the first of itself and
    its neighbours, in the first rounds on to what that points to, some times over, which shortens chains that
    descend, and contracts the edges to what their ends point to. Edges whose ends have met are gone, so that each round works
    on a fraction of the one before, whatever the shape of the graph. At the end the
    pointers of all rounds are followed back. Rounds are written to the shared folder,
    which cuts the lineage, and tables that no later step reads are deleted. Self-loops
    are allowed, nodes without edges are not in the result, and nulls are left out.
    Returns node, component.
    """
    edges = storage.saved(edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    left, pointers = edges.where("src <> dst"), []
    while not left.isEmpty():
        if len(pointers) == most_rounds:
            raise RuntimeError(f"edges are left after {most_rounds} rounds")
        pointer = pointed(left, len(pointers))
        if len(pointers) < OWN_ORDER:
            pointer = doubled(pointer)
        new = left.join(pointer.select(F.col("node").alias("src"), F.col("to").alias("a")), "src").join(pointer.select(F.col("node").alias("dst"), F.col("to").alias("b")), "dst")
        new = storage.saved(new.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
        if pointers:
            storage.discard(left)
        left = new
        pointers.append(pointer)
    roots = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("root"))
    if pointers:
        followed = pointers[-1]
        for pointer in reversed(pointers[:-1]):
            later = followed.select(F.col("node").alias("to"), F.col("to").alias("further"))
            followed = pointer.join(later, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        # the first pointers have all nodes but those whose only edge is a loop
        roots = followed.withColumnRenamed("to", "root").union(roots.join(pointers[0], "node", "left_anti"))
    roots = storage.saved(roots, "roots")
    labels = storage.saved(roots.join(roots.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component"), "labels")
    storage.discard(edges, roots, *pointers)
    if pointers:
        storage.discard(left)
    return labels


def relabelled(labels: DataFrame, before: DataFrame | None, after: DataFrame) -> DataFrame:
    """node and component after pairs (id1, id2) appeared or went: only components with an end of such a pair are contracted."""
    own = None if hasattr(after, "saved_at") else storage.saved(after.select("id1", "id2"), "pairs")
    after = after if own is None else own
    changed = after
    if before is not None:
        # each pair once a side; one that only one side has appeared or went
        sides = before.select("id1", "id2", F.lit(1).alias("side")).union(after.select("id1", "id2", F.lit(2)))
        changed = sides.groupBy("id1", "id2").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a = b")
    ends = storage.saved(changed.select(F.explode(F.array("id1", "id2")).alias("node")).distinct(), "ends")
    parts = labels.join(ends, "node", "left_semi").select("component").distinct()
    nodes = storage.saved(labels.join(parts, "component", "left_semi").select("node").union(ends).distinct(), "nodes")
    # a component holds both ends of each of its pairs
    edges = after.select(F.col("id1").alias("src"), F.col("id2").alias("dst")).join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    again = connected_components(edges)
    new = storage.saved(labels.join(nodes, "node", "left_anti").unionByName(again), "labels")
    storage.discard(ends, nodes, again, *([] if own is None else [own]))
    return new


def pointed(edges: DataFrame, turn: int) -> DataFrame:
    """node and to for each end of an edge: the first of its neighbours and itself in this turn's order."""
    place = lambda c: F.struct(F.xxhash64(F.lit(turn), c), c.alias("node")) if turn >= OWN_ORDER else F.struct(c.alias("node"))
    both = edges.union(edges.select("dst", "src"))
    first = both.groupBy(F.col("src").alias("node")).agg(F.min(place(F.col("dst"))).alias("best"))
    return storage.saved(first.select("node", F.least(F.col("best"), place(F.col("node")))["node"].alias("to")), "pointers")


def doubled(pointer: DataFrame) -> DataFrame:
    """Pointers followed to what they point to, again and again until none moves or ``DOUBLINGS`` are done."""
    for _ in range(DOUBLINGS):
        further = pointer.select(F.col("node").alias("to"), F.col("to").alias("further"))
        new = storage.saved(pointer.join(further, "to").select("node", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")), "pointers")
        storage.discard(pointer)
        pointer, done = new.drop("moved"), new.where("moved").isEmpty()
        pointer.saved_at = new.saved_at
        if done:
            break
    return pointer
