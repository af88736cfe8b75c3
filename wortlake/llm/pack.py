"""Filling containers of fixed capacity with items of varying length.

Method: harmonic packing. Lengths fall into classes by reciprocal of the capacity: k items of a length in
(capacity / (k + 1), capacity / k] fill a container of class k, whichever they are. So the containers of a
class are filled by counting, k items each, in every shard for itself: shards are made by a hash of the id and no
shard waits for another. Containers of classes 1 and 2, which would stay emptiest, first take one item of the greatest
class that surely fits their room, again by counting. Lengths up to capacity / CLASSES are the sand: they are poured by
prefix sums, first into what the containers of the shard have left, then into containers of their own.

Everything is window functions over shards of some SHARD_ROWS rows, one shuffle, no Python, and nothing
depends on the order in which rows arrive: a lost task gives the same containers again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSES = 24
SHARD_ROWS = 20_000


def pack(df: DataFrame, item: str, size: str, capacity: int, *, rows: int, classes: int = CLASSES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(item, piece, first, length, container): every item in a container whose lengths sum to at most capacity.

    An item longer than the capacity is cut into pieces of the capacity and a rest, numbered from 0, with
    `first` the offset in the item; others are one piece and never cut. Null and zero sizes are one piece of
    length 0. Repeated items are packed as often as they occur; items equal in id and size may trade places.
    rows: the number of rows of df (or an estimate; it only sets the number of shards). item must be unique
    for a fixed result, and not null.
    """
    if capacity < 1 or classes < 2:
        raise ValueError("capacity must be at least 1 and classes at least 2")
    shards = max(1, -(-rows // shard_rows))
    sand = capacity // classes
    total = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0))
    pieces = (
        df.select(F.col(item).alias("item"), total.alias("total"))
        .repartition(F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"))
        .withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), (F.greatest(F.col("total") - 1, F.lit(0)) / capacity).cast("int"))))
        .withColumn("first", F.col("piece").cast("bigint") * capacity)
        .withColumn("length", F.least(F.lit(capacity).cast("bigint"), F.col("total") - F.col("first")))
        .withColumn("kind", F.when(F.col("length") > sand, F.floor(F.lit(capacity) / F.col("length")).cast("int")).otherwise(0))
    )
    order = ("item", "piece")
    in_class = Window.partitionBy("shard", "kind").orderBy(*order)
    numbered = pieces.withColumn("bin", F.when(F.col("kind") > 0, F.floor((F.row_number().over(in_class) - 1) / F.col("kind"))).cast("bigint"))
    in_bin = Window.partitionBy("shard", "kind", "bin")
    first = F.row_number().over(in_bin.orderBy(*order)) == 1
    # Containers of classes 1 and 2 leave the most. One with room for a whole item of class k or more (room in
    # (capacity / k, capacity / (k - 1)]) is a host for one item of class k: the n-th host takes the n-th item.
    left = capacity - F.sum("length").over(in_bin)
    roomy = numbered.withColumn("left", F.when(F.col("kind").isin(1, 2) & first, left).otherwise(0))
    host = F.col("left") > sand
    matched = F.when(host, F.floor(F.lit(capacity) / F.col("left")).cast("int") + 1).when(F.col("kind") > 2, F.col("kind"))
    sided = roomy.withColumn("host", host).withColumn("match", matched)
    side = Window.partitionBy("shard", "match", "host").orderBy(*order)
    paired = sided.withColumn("nth", F.when(F.col("match").isNotNull(), F.row_number().over(side))).withColumn(
        "hosts", F.sum(F.col("host").cast("bigint")).over(Window.partitionBy("shard", "match"))
    )
    one = Window.partitionBy("shard", "match", "nth")
    taken = F.max(F.when(F.col("host"), F.struct("kind", "bin"))).over(one)
    guest = ~F.col("host") & F.col("match").isNotNull() & (F.col("nth") <= F.col("hosts"))
    moved = paired.withColumn("_taken", taken).withColumn("guest", guest)
    settled = moved.withColumn(
        "bin",
        F.when(F.col("guest"), F.col("_taken.bin"))
        .when(F.col("match").isNotNull() & ~F.col("host"), F.floor((F.col("nth") - F.col("hosts") - 1) / F.col("kind")))
        .otherwise(F.col("bin")),
    ).withColumn("kind", F.when(F.col("guest"), F.col("_taken.kind")).otherwise(F.col("kind")))
    # What a container has left for sand: grains that start within `room` end within the capacity.
    closing = (F.col("kind") > 0) & (F.row_number().over(in_bin.orderBy(*order)) == 1)
    filled = settled.select("shard", "item", "piece", "first", "length", "kind", "bin").withColumn(
        "room", F.when(closing, F.greatest(capacity - F.sum("length").over(in_bin) - sand + 1, F.lit(0))).otherwise(0)
    )
    before = Window.partitionBy("shard").orderBy("kind", "bin", "item", "piece").rowsBetween(Window.unboundedPreceding, -1)
    poured = filled.withColumn("rooms", F.coalesce(F.sum("room").over(before), F.lit(0))).withColumn(
        "grains", F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("length")).otherwise(0)).over(before), F.lit(0))
    )
    # Containers with room and grains on one line of offsets: a grain goes to the last container at or before it.
    placed = poured.withColumn("at", F.when(F.col("kind") == 0, F.col("grains")).otherwise(F.col("rooms")))
    line = Window.partitionBy("shard").orderBy("at", F.col("kind") == 0, "kind", "bin", "item", "piece").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("room").over(Window.partitionBy("shard"))
    own = F.struct(F.col("kind").alias("kind"), F.col("bin").alias("bin"))
    host = F.last(F.when(F.col("room") > 0, own), ignorenulls=True).over(line)
    beyond = F.floor((F.col("at") - F.col("end")) / max(1, capacity - sand + 1)).cast("bigint")
    fresh = F.struct(F.lit(0).alias("kind"), beyond.alias("bin"))
    chosen = F.when(F.col("kind") > 0, own).when((F.col("at") < F.col("end")) & F.col("host").isNotNull(), F.col("host")).otherwise(fresh)
    return placed.withColumn("host", host).withColumn("end", end).withColumn("_to", chosen).select(
        F.col("item").alias(item),
        "piece",
        "first",
        "length",
        ((F.col("shard") * classes + F.col("_to.kind")) * F.lit(1 << 32) + F.col("_to.bin")).alias("container"),
    )
