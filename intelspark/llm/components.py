"""Connected components of a link table by contraction to smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intelspark.session import cut_lineage

MAX_ROUNDS = 60
JOINED = 4  # rounds whose moves are joined in one query


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b): root is the smallest node reachable.

    Each round points a node at its smallest neighbour and moves every link to the nodes pointed at, so
    the graph shrinks at least by half; a node with very many links only meets sums and joins with one
    row per key. The links of a round are cut from lineage in the shared folder; its moves are a sum over them, made
    again at the end. Null ends are ignored, repeated links and self links do no harm, and no links give no rows.
    """
    edges = cut_lineage(
        links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null and a <> b").distinct())
    moves = []
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("to"))
        moves.append(move)
        to_a = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        to_b = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = cut_lineage(
            edges.join(to_a, "a").join(to_b, "b")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # A later round holds only nodes that an earlier one pointed at, so roots are found from the last round back.
    root = moves[-1]
    for at, move in enumerate(reversed(moves[:-1]), 1):
        later = root.select(F.col("node").alias("to"), F.col("to").alias("end"))
        root = move.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
        if at % JOINED == 0:
            root = cut_lineage(root)
    return cut_lineage(root).select("node", F.col("to").alias("root"))
