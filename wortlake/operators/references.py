"""References to records that do not exist.

Method: the sorted integer keys of the parents are compressed into contiguous runs [lo, hi); each reference
is matched as of its key to the run with the greatest start not above it, and is an orphan if there is none
or if its key is at or beyond that run's end. A parent key is any integer: an id, or the microseconds in
which a record existed (then deleted parents and parents that come later are found by the same match).

The runs of one group are one row, so the references are joined once, on the group. Catalyst broadcasts the
runs only if their estimated or measured size is below its threshold; else the join is a sort-merge join in
which AQE splits hot groups of references (the side that is split is the outer side, the runs are
replicated). Runs of single keys are cut at multiples of `slot_width` and the slot joins the group as a key: so
a list of runs is bounded by half the slot width, however many parents a group has. Runs of ranges, the lifetimes of
one record, are cut into chunks of CHUNK runs in order; a group has a directory of the chunks' starts, a reference is matched
as of its key to a chunk and then to a run in it. Both lists are searched by halving, so a reference costs the logarithm of its group's runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wortlake.functions.names import fresh

MISSING, LATER, GONE = "missing", "not_yet", "deleted"
_FOREVER = 9223372036854775807
SLOT = 4096
CHUNK = 4096


def contiguous_runs(parents: DataFrame, group: Sequence[str], lo: str, hi: str | None = None) -> DataFrame:
    """Runs (group columns, lo, hi) of parents: touching and overlapping ranges [lo, hi) become one.

    Without `hi` every key stands for itself. A null hi means without end. Null keys and null group values
    never match a reference and are left out; empty and repeated ranges are of no account.
    """
    upper = F.col(lo) + 1 if hi is None else F.coalesce(F.col(hi), F.lit(_FOREVER))
    ranges = (
        parents.select(*group, F.col(lo).alias("lo"), upper.alias("hi"))
        .where(F.col("lo").isNotNull() & (F.col("hi") > F.col("lo")))
        .dropna(subset=list(group))
        .groupBy(*group, "lo")  # combined map-side: repeated keys never reach a window
        .agg(F.max("hi").alias("hi"))
    )
    ordered = Window.partitionBy(*group).orderBy("lo")
    before = F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("_new", F.when(F.col("lo") <= before, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(ordered))
    return islands.groupBy(*group, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def as_of_status(references: DataFrame, parents: DataFrame, on: Sequence[tuple[str, str]], key: str, lo: str, hi: str | None = None, *, slot_width: int | None = SLOT) -> DataFrame:
    """The references with a column `status`: null where the parent exists, else missing, not_yet or deleted.

    on: pairs (column of references, column of parents) that must be equal. Null on either side, or a null
    key, is missing. For single keys (no hi) slot_width bounds the lists of runs, and every orphan is missing, as what lies
    in other slots is not looked at; slot_width=None looks at whole groups and tells the three apart.
    An empty parent table makes every reference missing; repeated references are all kept. Other columns stay as they
    are; one named status is replaced.
    """
    *group, slot, runs_of = fresh(references.columns, *(f"_g{i}" for i in range(len(on))), "_slot", "_runs")
    source = parents.select(*(F.col(p).alias(g) for g, (_, p) in zip(group, on, strict=True)), F.col(lo).alias("_lo"), *([F.col(hi).alias("_hi")] if hi else []))
    slot_width = None if hi else slot_width
    if slot_width:
        group.append(slot)
        source = source.withColumn(slot, F.floor(F.col("_lo") / slot_width))
    runs = contiguous_runs(source, group, "_lo", "_hi" if hi else None)
    keyed = [F.col(r) for r, _ in on] + ([F.floor(F.col(key) / slot_width)] if slot_width else [])
    met = [k == F.col(g) for k, g in zip(keyed, group, strict=True)]
    listed = F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias(runs_of)
    if slot_width:
        joined = references.join(runs.groupBy(*group).agg(listed), met, "left")
        began = F.lit(False)
    else:
        chunk, starts, at, *again = fresh([*references.columns, *group, runs_of], "_chunk", "_starts", "_at", *(f"_c{i}" for i in range(len(on))))
        lists = runs.withColumn(chunk, F.floor((F.row_number().over(Window.partitionBy(*group).orderBy("lo")) - 1) / CHUNK)).groupBy(*group, chunk).agg(listed)
        directory = lists.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.element_at(runs_of, 1)["lo"].alias("lo"), F.col(chunk).alias("chunk")))).alias(starts))
        placed = references.join(directory, met, "left").withColumn(at, as_of(F.col(starts), F.col(key))["chunk"])
        same = [F.col(g) == F.col(c) for g, c in zip(group, again, strict=True)]
        joined = placed.join(lists.withColumnsRenamed(dict(zip(group, again, strict=True))), [*same, F.col(at) == F.col(chunk)], "left").drop(*again, at, chunk)
        began = F.col(starts).isNotNull()
        runs_of_any = starts
    preceding = as_of(F.col(runs_of), F.col(key))
    none = F.col(runs_of).isNull() & ~began
    status = (
        F.when(none | F.col(key).isNull(), MISSING)
        .when(preceding.isNull(), MISSING if slot_width else LATER)
        .when(F.col(key) >= preceding["hi"], MISSING if slot_width else GONE)
    )
    return joined.withColumn("status", status).drop(*group, runs_of, *([] if slot_width else [runs_of_any]))


def as_of(sorted_runs: Column, key: Column) -> Column:
    """The last struct of an array sorted by its field lo whose lo is not above the key, found by halving; null if there is none."""

    def halved(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        below = F.get(sorted_runs, middle)["lo"] <= key
        return F.when(s["lo"] == s["hi"], s).when(below, F.struct(middle.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (middle - 1).alias("hi")))

    start = F.struct(F.lit(-1).alias("lo"), (F.size(sorted_runs) - 1).alias("hi"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_runs) + F.lit(1.0))).cast("int"))
    found = F.aggregate(steps, start, halved, lambda s: s["lo"])
    return F.when(F.size(sorted_runs) > 0, F.get(sorted_runs, found))


def orphans(references: DataFrame, parents: DataFrame, on: Sequence[tuple[str, str]], key: str, lo: str, hi: str | None = None, *, slot_width: int | None = SLOT) -> DataFrame:
    """The rows of `as_of_status` whose parent does not exist."""
    return as_of_status(references, parents, on, key, lo, hi, slot_width=slot_width).where("status IS NOT NULL")


def orphan_report(cases: DataFrame) -> DataFrame:
    """Orphans counted by src_table, period and status; the counts are combined before the shuffle."""
    return cases.groupBy("src_table", "period", "status").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_name").alias("n_names"))
