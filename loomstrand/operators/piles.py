"""Per-read coverage: histograms by event sweep, valid regions, medians, slopes and the regions made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstrand.functions.columns import MIN_REGION_BINS, saturate, to_bin

SLOPE_BINS = 847 >> 4
CLUSTER_GAP = 479 >> 4
CLUSTER_SIZE = 12


def coverage_intervals(overlaps: DataFrame) -> DataFrame:
    """(read_id, bin, span): the bins that each overlap covers on either read; the outermost bin of both ends is spared."""
    side = lambda s: overlaps.select(F.col(f"{s}_id").alias("read_id"), (to_bin(F.col(f"{s}_begin")) + 1).alias("bin"), (to_bin(F.col(f"{s}_end")) - to_bin(F.col(f"{s}_begin")) - 2).alias("span"))
    return side("lhs").unionByName(side("rhs")).where("span > 0")


def coverage_runs(intervals: DataFrame) -> DataFrame:
    """(read_id, begin, end, cov): maximal runs between boundaries, by an event sweep. Events of one place are summed
    before the window, so that its rows are boundaries and not overlaps."""
    one, less = F.lit(1).cast("long"), F.lit(-1).cast("long")
    events = intervals.select("read_id", F.explode(F.array(F.struct(F.col("bin").alias("at"), one.alias("d")), F.struct((F.col("bin") + F.col("span")).alias("at"), less.alias("d")))).alias("e"))
    summed = events.groupBy("read_id", F.col("e.at").alias("begin")).agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy("read_id").orderBy("begin")
    running = F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return summed.select("read_id", "begin", F.lead("begin").over(order).alias("end"), saturate(running).alias("cov")).where("end is not null")


def coverage_bins(runs: DataFrame) -> DataFrame:
    """(read_id, bin, cov): one row per bin between the first and last boundary."""
    return runs.select("read_id", F.explode(F.sequence("begin", F.col("end") - 1)).alias("bin"), "cov")


def valid_regions(runs: DataFrame, coverage: int = 4) -> DataFrame:
    """(read_id, begin, end, bins): the longest stretch of bins covered at least so much, first among equals. Reads
    without any have no row; shorter than `MIN_REGION_BINS` means invalid."""
    order = Window.partitionBy("read_id").orderBy("begin")
    good = runs.where(F.col("cov") >= coverage)
    new = F.when(F.lag("end").over(order) == F.col("begin"), 0).otherwise(1)
    island = good.withColumn("new", new).withColumn("island", F.sum("new").over(order))
    size = island.groupBy("read_id", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).withColumn("bins", F.col("end") - F.col("begin"))
    best = size.groupBy("read_id").agg(F.max_by(F.struct("begin", "end", "bins"), F.struct("bins", -F.col("begin"))).alias("r"))
    return best.select("read_id", "r.begin", "r.end", "r.bins")


def is_valid(bins: Column) -> Column:
    return bins >= MIN_REGION_BINS


def upper_median(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, median: the value at place n div 2 (from 0) of the ascending values; `weight` counts a row several times.

    Values are counted first, so that what is ordered is the histogram of each key's values, however many rows it has."""
    counts = rows.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("w"))
    spec = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = F.sum("w").over(spec.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("w").over(spec)
    ranked = counts.withColumn("upto", upto).withColumn("half", F.floor(total / 2))
    return ranked.where(F.col("upto") > F.col("half")).groupBy(*keys).agg(F.min(value).alias("median"))


def slope_maxima(bins: DataFrame, w: int = SLOPE_BINS) -> DataFrame:
    """bins with the largest coverage of the w bins before (left_max) and after (right_max); null where there is none."""
    order = Window.partitionBy("read_id").orderBy("bin")
    return bins.withColumn("left_max", F.max("cov").over(order.rowsBetween(-w, -1))).withColumn("right_max", F.max("cov").over(order.rowsBetween(1, w)))


def slope_runs(bins: DataFrame, q: float, w: int = SLOPE_BINS) -> DataFrame:
    """(read_id, type, first, last): runs of bins from which coverage falls to (down, 0) or rises from (up, 1) under a
    q-th of a neighbouring maximum."""
    low = F.floor(saturate(F.col("cov") * q)).cast("long")
    kinds = slope_maxima(bins, w).select("read_id", "bin", F.array(F.when(F.col("left_max") > low, 0), F.when(F.col("right_max") > low, 1)).alias("types"))
    marks = kinds.select("read_id", "bin", F.explode("types").alias("type")).where("type is not null")
    island = F.col("bin") - F.row_number().over(Window.partitionBy("read_id", "type").orderBy("bin"))
    return marks.withColumn("island", island).groupBy("read_id", "type", "island").agg(F.min("bin").alias("first"), F.max("bin").alias("last")).drop("island")


def dip_regions(slopes: DataFrame) -> DataFrame:
    """(read_id, first, last): from each down slope to an up slope that follows it at once."""
    order = Window.partitionBy("read_id").orderBy("first", "type", "last")
    pairs = slopes.select("read_id", "type", "first", F.lead("type").over(order).alias("next"), F.lead("last").over(order).alias("last"))
    return pairs.where("type = 0 and next = 1").select("read_id", "first", "last")


def merge_regions(regions: DataFrame) -> DataFrame:
    """(read_id, first, last): regions that overlap by more than an end, merged transitively. Equal regions that end where
    they begin do not overlap, so each stays a row; missing places stand after all others."""
    order = Window.partitionBy("read_id").orderBy(F.asc_nulls_last("first"), F.asc_nulls_last("last"))
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach > F.col("first"), 0).otherwise(1)
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return regions.withColumn("new", new).withColumn("island", island).groupBy("read_id", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def kmer_clusters(marks: DataFrame) -> DataFrame:
    """(read_id, first, last, marks): clusters of more than 12 marked bins with gaps of 29 bins at most."""
    order = Window.partitionBy("read_id").orderBy("bin")
    new = F.when(F.col("bin") - F.lag("bin").over(order) <= CLUSTER_GAP, 0).otherwise(1)
    cluster = marks.select("read_id", "bin").distinct().withColumn("new", new).withColumn("cluster", F.sum("new").over(order))
    return cluster.groupBy("read_id", "cluster").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.count("*").alias("marks")).where(F.col("marks") > CLUSTER_SIZE).drop("cluster")


def longest_segments(piles: DataFrame, regions: DataFrame) -> DataFrame:
    """(read_id, begin, end): the longest stretch of each read's region between its chimeric regions, first among equals.
    piles: read_id, begin, end; regions: read_id, first, last, within the read's region."""
    order = Window.partitionBy("read_id").orderBy("at")
    cuts = regions.join(piles, "read_id").where((F.col("begin") <= F.col("first")) & (F.col("last") <= F.col("end"))).select("read_id", F.col("first").alias("at"), F.col("last").alias("next"))
    edges = piles.select("read_id", F.col("end").alias("at"), F.lit(None).cast("long").alias("next"), "begin")
    spans = cuts.withColumn("begin", F.lit(None).cast("long")).unionByName(edges)
    starts = F.coalesce(F.lag("next").over(order), F.max("begin").over(Window.partitionBy("read_id")))
    segment = spans.select("read_id", starts.alias("begin"), F.col("at").alias("end"))
    return segment.groupBy("read_id").agg(F.max_by(F.struct("begin", "end"), F.struct(F.col("end") - F.col("begin"), -F.col("begin"))).alias("s")).select("read_id", "s.begin", "s.end")


FUZZ = 420 >> 4


def _facing(overlaps: DataFrame, regions: DataFrame) -> DataFrame:
    """Overlap sides that meet a repetitive region of their read; regions: read_id, first, last, p_begin, p_end (bins)."""
    sides = [overlaps.select("overlap_id", F.col(f"{s}_id").alias("read_id"), to_bin(F.col(f"{s}_begin")).alias("b"), to_bin(F.col(f"{s}_end")).alias("e")) for s in ("lhs", "rhs")]
    rows = sides[0].unionByName(sides[1]).join(regions, "read_id").where((F.col("b") < F.col("last")) & (F.col("first") < F.col("e")))
    return rows.withColumn("offset", F.floor(0.1 * (F.col("p_end") - F.col("p_begin"))).cast("long"))


def bridged_regions(overlaps: DataFrame, regions: DataFrame) -> DataFrame:
    """regions with `bridged`: some overlap reaches from the read's inside beyond a repeat at one of its ends."""
    rows = _facing(overlaps, regions)
    head, tail = F.col("b") - F.col("p_begin"), F.col("p_end") - F.col("e")
    left = (F.col("first") < F.col("p_begin") + F.col("offset")) & (head < tail)
    right = ~left & (F.col("last") > F.col("p_end") - F.col("offset")) & (head > tail)
    over = (left & (F.col("e") >= F.col("last") + FUZZ)) | (right & (F.col("b") + FUZZ <= F.col("first")))
    found = rows.groupBy("read_id", "first", "last").agg(F.bool_or(over).alias("bridged"))
    return regions.join(found, ["read_id", "first", "last"], "left").withColumn("bridged", F.coalesce("bridged", F.lit(False)))


def repeat_induced(overlaps: DataFrame, regions: DataFrame) -> DataFrame:
    """Distinct overlap_id that end inside a bridged repeat; regions as bridged_regions() returns them."""
    rows = _facing(overlaps, regions.where("bridged"))
    left = F.col("first") < F.col("p_begin") + F.col("offset")
    right = ~left & (F.col("last") > F.col("p_end") - F.col("offset"))
    bad = (left & (F.col("e") < F.col("last") + FUZZ)) | (right & (F.col("b") + FUZZ > F.col("first")))
    return rows.where(bad).select("overlap_id").distinct()
