"""The N highest-scoring items of every group, ties broken by a fixed rule.

Method: descending score bands. The scores are cut into bands at their quantiles over all rows; per group the
bands are filled from the top, and every band below the one that fills the group is closed. Closed bands
are anti-joined away before anything is shuffled, and what is left, the open bands with the boundary
band, is ranked exactly with the ties in order.

Only groups that hold more than 1 / HEAVY of all rows have bands to close, so there are fewer than HEAVY
of them, whatever the data: that bound is what lets them be broadcast. A sketch of frequent items, made in the pass that
finds the edges, names them, so only their rows are counted per band. In all other groups every band
stays open, as in a heavy one that the sketch might miss: the result is the same. The rank has a limit, so Spark cuts each group to N rows in every map task before the shuffle
(WindowGroupLimit): a hot group, or a boundary band of ties that holds a third of all rows, sends N rows
a task and is never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wortlake.functions.names import fresh

BANDS = 16
HEAVY = 1000


def band_edges(df: DataFrame, score: str, group: str, bands: int = BANDS, heavy: int = HEAVY) -> tuple[list, int, list]:
    """The inner edges of the score bands, descending, the number of rows, and the groups that may be heavy.

    The edges are quantiles over all rows, fine at the top, where groups fill; at most bands - 1 edges and `heavy` groups come to the driver. The
    sketch holds every group of more than some 1 / (2 heavy) of the rows. Its groups are of an atomic type.
    """
    wanted = [1 - 2.0**-i for i in range(1, bands)]
    tracked = 1 << max(10, (16 * heavy - 1).bit_length())
    often = F.expr(f"approx_top_k(`{group}`, {heavy}, {min(tracked, 1 << 19)})")
    edges, rows, items = df.agg(F.percentile_approx(score, wanted, 10_000), F.count("*"), often).first()
    return sorted(set(edges or []), reverse=True), rows, [i["item"] for i in items or [] if i["item"] is not None]


def band_of(score: str, edges: Sequence) -> Column:
    """0 for the top band; a score on an edge belongs to the band above it."""
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(F.col(score) >= edges[i], i).otherwise(out)
    return out


def filled_groups(banded: DataFrame, group: str, band: str, n: int, least: float) -> DataFrame:
    """Per group of more than `least` rows the last open band, the one in which it has n rows: (_filled, _last).

    The rows are counted per group and band, combined map-side.
    """
    counts = banded.groupBy(group, band).agg(F.count("*").alias("_rows"))
    large = counts.groupBy(group).agg(F.sum("_rows").alias("_size"), F.sort_array(F.collect_list(F.struct(band, "_rows"))).alias("_bands"))
    large = large.where((F.col("_size") > least) & (F.col("_size") > n))
    filled = F.aggregate(
        "_bands",
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("band")),
        lambda acc, b: F.struct((acc["seen"] + b["_rows"]).alias("seen"), F.coalesce(acc["band"], F.when(acc["seen"] + b["_rows"] >= n, b[band])).alias("band")),
    )
    return large.select(F.col(group).alias("_filled"), filled["band"].alias("_last"))


def top_n(df: DataFrame, group: str, score: str, tie: Sequence[str], n: int, *, bands: int = BANDS, heavy: int = HEAVY, rank: str = "rnk") -> DataFrame:
    """The n rows of each group with the highest score, equal scores in ascending order of the tie columns.

    Rows with null group or score are left out. Repeated rows count as rows; rows equal in score and all tie
    columns come in any order among themselves, so give a unique tie for a fixed result. Groups of fewer
    rows come out whole, an empty table gives an empty one. `rank` counts from 1; a column of that name is replaced.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.where(F.col(group).isNotNull() & F.col(score).isNotNull())
    edges, total, often = band_edges(rows, score, group, bands, heavy)
    band, group_key, last = fresh(df.columns, "_band", "_filled", "_last")
    banded = rows.withColumn(band, band_of(score, edges))
    named = df.sparkSession.createDataFrame([(g,) for g in often], StructType([StructField(group_key, df.schema[group].dataType)]))
    few = banded.select(group, band).join(F.broadcast(named), F.col(group) == F.col(group_key), "left_semi")
    filled = filled_groups(few, group, band, n, total / heavy)
    # Fewer than `heavy` groups hold more than total / heavy rows.
    filled = filled.toDF(group_key, last)
    closed = (F.col(group) == F.col(group_key)) & (F.col(band) > F.col(last))
    open_bands = banded.join(F.broadcast(filled), closed, "left_anti").drop(band)
    order = Window.partitionBy(group).orderBy(F.desc(score), *tie)
    return open_bands.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)
