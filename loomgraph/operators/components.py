"""Connected components over an edge table: alternating large-star and small-star rounds.

Every round is a group-by minimum and a join, so no component is ever gathered anywhere, and
written tables cut the lineage between rounds.  The centre of a large star has many edges: where
they are more than a task's share, they get its minimum from the plan itself and are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import cut

#: Edges of a node, at least, that are not shuffled to one task, and the nodes with that many at most.
HOT, CENTRES = 256, 256
#: Edges of a written file at least, but for the last.
FILE_EDGES = 1 << 18


def _stars(edges: DataFrame, centres: dict[int, int] | None = None) -> DataFrame:
    """One operation over edges (u, v) with u > v: the small star, or with ``centres``, the nodes of
    many edges and the least node beside each, the large one."""
    sides = edges if centres is None else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    many, rest = None, sides
    if centres:
        least_of = F.create_map(*[F.lit(x) for pair in centres.items() for x in pair])
        many = sides.where(F.col("u").isin(list(centres))).select("u", "v", F.element_at(least_of, F.col("u")).alias("m"))
        rest = sides.where(~F.col("u").isin(list(centres)))
    least = rest.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = rest.join(least, "u")
    if centres is None:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        joined = joined if many is None else joined.unionByName(many)
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple[int, int, int, DataFrame]:
    """How many edges there are, how many nodes have a lesser one and others beside them, the most edges of
    a node, and (u, n, m): each node's edges and the least node among it and those beside it."""
    ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    nodes = ends.groupBy("u").agg(F.count("*").alias("n"), F.least(F.min("v"), F.first("u")).alias("m"))
    k, loose, most = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1)), F.coalesce(F.max("n"), F.lit(0))).first()
    return k // 2, loose, most, nodes


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Nodes are of any ordered type.  Self-loops, repeated and null edges add nothing; an empty table gives an
    empty one.  Rounds go on until every node but the least of its component has one edge, O(log² n) of them.
    No round adds edges, so a table of them is as few files as those before it need.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e, "edges")
    k, loose, most, nodes = _state(e)
    while loose:
        hot = max(HOT, 2 * k // CENTRES)  # so many nodes at most have more
        centres = {r["u"]: r["m"] for r in nodes.where(F.col("n") > hot).collect()} if most > hot else {}
        e = cut(_stars(_stars(e, centres)).coalesce(k // FILE_EDGES + 1), "edges")
        k, loose, most, nodes = _state(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
