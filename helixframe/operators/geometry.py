"""Distance joins and the features built on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from helixframe.functions.constants import GRAPH_CUTOFF, NUM_RBF, RBF_MAX
from helixframe.functions.group_distances import least_distances

AXES = ("x", "y", "z")


def squared_distance(left: str, right: str) -> Column:
    parts = [(F.col(f"{left}{a}") - F.col(f"{right}{a}")) for a in AXES]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def near_pairs(
    points: DataFrame, others: DataFrame, cutoff: float, key: str = "structure_id", cells_per_cutoff: float = 2.0
) -> DataFrame:
    """Pairs within ``cutoff`` inside ``key`` as an equi-join on grid cells.

    Both sides carry ``key, x, y, z`` plus their own columns (names must differ
    apart from the key).  ``points`` rows go to one cell; ``others`` rows are
    copied to the few cells that their cutoff cube touches (give the smaller side
    there).  Every pair meets in exactly one cell, so nothing is deduplicated, and
    the cell in the join key spreads one large structure over all tasks.
    """
    size = float(cutoff) * cells_per_cutoff
    left = points.select(
        *[c for c in points.columns if c not in AXES],
        *[F.col(a).alias(f"p_{a}") for a in AXES],
        *[F.floor(F.col(a) / size).alias(f"_c{a}") for a in AXES],
    )
    right = others.select(
        *[c for c in others.columns if c not in AXES], *[F.col(a).alias(f"q_{a}") for a in AXES])
    for a in AXES:
        q = F.col(f"q_{a}")
        right = right.withColumn(
            f"_c{a}",
            F.explode(F.sequence(F.floor((q - cutoff) / size), F.floor((q + cutoff) / size))))
    return (
        left.join(right, [key, "_cx", "_cy", "_cz"])
        .withColumn("d2", squared_distance("p_", "q_"))
        .where(F.col("d2") <= F.lit(float(cutoff) * float(cutoff) + 1e-6))
        .drop("_cx", "_cy", "_cz")
    )


#: Groups of either side that meet in one row of ``group_distances``, and cells of its grid for a cutoff.
GROUPS, CELLS_PER_CUTOFF = 64, 3.0


def point_groups(points: DataFrame, by: Sequence[str], part: Column | None = None, key: str = "structure_id") -> DataFrame:
    """A row for each group of points with its box: ``key``, ``by``, ``points``, ``lo_*``, ``hi_*``.  ``part``: a number from 0."""
    finite = [F.abs(F.col(a)) < float("inf") for a in AXES]
    one = F.struct(*AXES, (F.lit(0) if part is None else F.coalesce(part, F.lit(-1))).cast("tinyint").alias("part"))
    return points.where(finite[0] & finite[1] & finite[2] & F.col(key).isNotNull()).groupBy(key, *by).agg(
        F.collect_list(one).alias("points"), *[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])


def group_distances(
    groups: DataFrame, others: DataFrame, cutoff: float, by: Sequence[str], others_by: Sequence[str], parts: int = 1, key: str = "structure_id"
) -> DataFrame:
    """``key, *by, *others_by, d0, d1 ...``: smallest squared distance of two groups (``point_groups``) inside ``key`` to points of
    each part of the other one, NULL beyond ``cutoff``; a row for each pair that has one.

    A group is copied to the grid cells that its box touches, one of ``others`` to those in reach (the smaller side), and groups
    of a cell meet in blocks.  A pair is taken up in the first cell that both lie in only: it needs no shuffle after the join,
    whose input is that of the groups however many pairs are close.  Cells are as wide as the widest group of their ``key`` at
    least, so that a group is in few of them."""
    far = float(cutoff) + 1e-3
    widest = lambda d: d.groupBy(key).agg(F.max(F.greatest(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in AXES])).alias("_w"))
    # Only keys that both sides have.
    sizes = widest(groups).join(widest(others).withColumnRenamed("_w", "_v"), key).select(
        key, F.greatest(F.lit(float(cutoff) * CELLS_PER_CUTOFF), "_w", "_v").alias("_size"))

    def blocks(side: DataFrame, names: Sequence[str], reach: float, out: str) -> DataFrame:
        cell = lambda c, more: F.floor((F.col(c) + F.lit(more)) / F.col("_size"))
        placed = side.join(sizes, key).select(key, F.struct(
            F.struct(*names).alias("id"), "points", *[f"{n}_{a}" for n in ("lo", "hi") for a in AXES],
            *[cell(f"lo_{a}", -reach).alias(f"first_{a}") for a in AXES]).alias("g"), *[cell(f"hi_{a}", reach).alias(f"_last_{a}") for a in AXES])
        for a in AXES:
            placed = placed.withColumn(f"_c{a}", F.explode(F.sequence(F.col(f"g.first_{a}"), F.col(f"_last_{a}"))))
        held = placed.groupBy(key, *[f"_c{a}" for a in AXES]).agg(F.collect_list("g").alias("_g"))
        begin = F.explode(F.sequence(F.lit(1), F.size("_g"), F.lit(GROUPS))).alias("_at")
        return held.select("*", begin).select(key, *[f"_c{a}" for a in AXES], F.slice("_g", F.col("_at"), F.lit(GROUPS)).alias(out))

    met = blocks(groups, by, 0.0, "a").join(blocks(others, others_by, far, "b"), [key, *[f"_c{a}" for a in AXES]])
    named = lambda side, names: StructType([side.schema[n] for n in names])
    out = StructType([groups.schema[key], StructField("a", named(groups, by)), StructField("b", named(others, others_by)),
                      *[StructField(f"d{k}", DoubleType()) for k in range(parts)]])
    found = met.mapInArrow(partial(least_distances, key=key, cutoff=float(cutoff), far=far, parts=parts), out)
    return found.select(key, *[F.col(f"a.{n}") for n in by], *[F.col(f"b.{n}") for n in others_by], *[f"d{k}" for k in range(parts)])


def min_group_distance(a: DataFrame, b: DataFrame, cutoff: float) -> DataFrame:
    """Smallest atom-atom distance of two residues, for those within ``cutoff``.

    ``a``: structure_id, a_id, x, y, z; ``b``: structure_id, b_id, x, y, z.
    """
    return (
        group_distances(point_groups(a, ["a_id"]), point_groups(b, ["b_id"]), cutoff, ["a_id"], ["b_id"])
        .select("structure_id", "a_id", "b_id", F.sqrt("d0").alias("dist"))
        .where(F.col("dist") <= cutoff)
    )


def residue_graph_edges(
    points: DataFrame, cutoff: float = GRAPH_CUTOFF, ends: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Ordered pairs with 0 < distance < cutoff.

    ``points``: structure_id, res_idx, x, y, z -> structure_id, src, dst, dist.  There are many more
    edges than points, so what edges need of points comes along: ``ends`` as src_* and dst_*,
    ``keep`` (same for a whole structure) once.
    """
    a = points.select("structure_id", F.col("res_idx").alias("src"), *[F.col(c).alias(f"src_{c}") for c in ends], *keep, *AXES)
    b = points.select("structure_id", F.col("res_idx").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in ends], *AXES)
    return (
        near_pairs(a, b, cutoff, cells_per_cutoff=1.0)
        .withColumn("dist", F.sqrt("d2"))
        .where((F.col("dist") < cutoff) & (F.col("dist") > 0))
        .select("structure_id", "src", "dst", "dist", *[f"{end}_{c}" for c in ends for end in ("src", "dst")], *keep)
    )


def rbf_encode(dist: Column, num_rbf: int = NUM_RBF, max_distance: float = RBF_MAX) -> Column:
    """Gaussian bins with evenly spaced centres; the spacing is the width."""
    width = max_distance / (num_rbf - 1) if num_rbf > 1 else max_distance
    centers = [max_distance * k / (num_rbf - 1) if num_rbf > 1 else 0.0 for k in range(num_rbf)]
    return F.array(*[F.exp(-(dist - c) * (dist - c) / (width * width)) for c in centers])


def sequence_separation(src: Column, dst: Column, n: Column) -> Column:
    return F.log1p(F.abs(src - dst)) / F.log1p(F.greatest(n - 1, F.lit(1)))


def edge_features(
    edges: DataFrame, sizes: DataFrame | None = None, num_rbf: int = NUM_RBF, max_distance: float = RBF_MAX
) -> DataFrame:
    """``edge_attr`` = distance bins followed by sequence separation.

    ``sizes``: structure_id, n_res (residues of the graph, isolated ones included); without it ``edges`` have n_res.
    """
    sep = sequence_separation(F.col("src"), F.col("dst"), F.col("n_res"))
    return (
        (edges if sizes is None else edges.join(sizes, "structure_id"))
        .withColumn("seq_sep", sep)
        .withColumn("edge_attr", F.concat(rbf_encode(F.col("dist"), num_rbf, max_distance), F.array("seq_sep")))
        .drop("n_res")
    )


def center_radius(points: DataFrame) -> DataFrame:
    """Coordinates minus the structure mean, and norm / 20.

    The means are one row per structure joined back, so a huge structure stays
    spread over its own partitions' partial sums.
    """
    means = points.groupBy("structure_id").agg(*[F.avg(a).alias(f"m_{a}") for a in AXES])
    j = points.join(means, "structure_id")
    for a in AXES:
        j = j.withColumn(f"c_{a}", F.col(a) - F.col(f"m_{a}"))
    radius = F.sqrt(F.col("c_x") * F.col("c_x") + F.col("c_y") * F.col("c_y") + F.col("c_z") * F.col("c_z")) / 20.0
    return j.withColumn("radius", radius).drop("m_x", "m_y", "m_z")


def neighbor_aggregate(
    nodes: DataFrame, edges: DataFrame, features: list[str], gate: str = "gate", scale: float = 0.1
) -> DataFrame:
    """One message pass: degree, summed neighbour features, mean gated offset.

    ``nodes``: structure_id, res_idx, x, y, z, features; ``edges``: structure_id,
    src, dst, gate.  Isolated nodes keep zeros.
    """
    source = nodes.select(
        "structure_id", F.col("res_idx").alias("src"),
        *[F.col(f).alias(f"s_{f}") for f in features], *[F.col(a).alias(f"s_{a}") for a in AXES])
    # sum(gate*(dst - src)) = dst*sum(gate) - sum(gate*src): only the source side
    # is joined to the edges.
    g = F.col(gate) * scale
    msg = edges.join(source, ["structure_id", "src"]).groupBy("structure_id", F.col("dst").alias("res_idx")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum(g).alias("_g"),
        *[F.sum(g * F.col(f"s_{a}")).alias(f"_g{a}") for a in AXES],
        *[F.sum(f"s_{f}").alias(f"sum_{f}") for f in features],
    )
    out = nodes.join(msg, ["structure_id", "res_idx"], "left")
    zero = F.lit(0.0)
    return out.select(
        "structure_id", "res_idx",
        F.coalesce("degree", F.lit(0)).alias("degree"),
        *[F.coalesce(f"sum_{f}", zero).alias(f"sum_{f}") for f in features],
        *[F.coalesce((F.col(a) * F.col("_g") - F.col(f"_g{a}")) / F.col("degree"), zero).alias(f"shift_{a}")
          for a in AXES],
    )


def graph_sizes(points: DataFrame) -> DataFrame:
    return points.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_res"))


def sized_edges(points: DataFrame) -> DataFrame:
    """``residue_graph_edges`` with the ``n_res`` of their graph, which is joined to the points."""
    return residue_graph_edges(points.join(graph_sizes(points), "structure_id"), keep=["n_res"])
