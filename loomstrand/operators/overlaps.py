"""Overlap algebra: reversal, length, clipping to valid regions, classification, finalisation, top-k, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstrand.functions.columns import MIN_SPAN, identity

COLUMNS = ["lhs_id", "lhs_begin", "lhs_end", "rhs_id", "rhs_begin", "rhs_end", "score", "strand"]
KINDS = {0: "internal", 1: "lhs contained", 2: "rhs contained", 3: "lhs to rhs", 4: "rhs to lhs"}


def reversed_overlaps(overlaps: DataFrame) -> DataFrame:
    """Sides exchanged; score and strand kept."""
    swap = {c: c.replace("lhs", "rhs") if "lhs" in c else c.replace("rhs", "lhs") for c in COLUMNS}
    return overlaps.select(*(F.col(swap[c]).alias(c) for c in COLUMNS))


def doubled(overlaps: DataFrame) -> DataFrame:
    """Each overlap seen from both of its reads."""
    return overlaps.select(*COLUMNS).unionByName(reversed_overlaps(overlaps))


def span(overlaps_side: str) -> Column:
    return F.col(f"{overlaps_side}_end") - F.col(f"{overlaps_side}_begin")


def overlap_length() -> Column:
    return F.greatest(span("lhs"), span("rhs"))


def longest_per_read(overlaps: DataFrame, k: int = 32) -> DataFrame:
    """The k longest overlaps of each lhs read; ties by rhs and places. The rank filter is pruned before the shuffle."""
    order = Window.partitionBy("lhs_id").orderBy(F.desc(overlap_length()), "rhs_id", "lhs_begin", "rhs_begin", "lhs_end", "rhs_end", "strand")
    return overlaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def with_piles(overlaps: DataFrame, piles: DataFrame) -> DataFrame:
    """Overlaps with both reads' regions (lb, le, rb, re), invalid reads dropped. Only scalar pile columns travel."""
    side = piles.where(~F.col("is_invalid")).select("read_id", "p_begin", "p_end")
    left = side.select(F.col("read_id").alias("lhs_id"), F.col("p_begin").alias("lb"), F.col("p_end").alias("le"))
    right = side.select(F.col("read_id").alias("rhs_id"), F.col("p_begin").alias("rb"), F.col("p_end").alias("re"))
    return overlaps.join(left, "lhs_id").join(right, "rhs_id")


def clip(overlaps: DataFrame, piles: DataFrame) -> DataFrame:
    """Overlaps cut to both reads' valid regions: what one side loses, the other loses at the matching end. Invalid reads,
    disjoint regions and spans under 84 bases drop the overlap. Keeps lb, le, rb, re."""
    meets = (F.col("lhs_begin") < F.col("le")) & (F.col("lhs_end") > F.col("lb")) & (F.col("rhs_begin") < F.col("re")) & (F.col("rhs_end") > F.col("rb"))
    over = lambda x: F.greatest(x, F.lit(0))
    l_head, l_tail = over(F.col("lb") - F.col("lhs_begin")), over(F.col("lhs_end") - F.col("le"))
    r_head, r_tail = over(F.col("rb") - F.col("rhs_begin")), over(F.col("rhs_end") - F.col("re"))
    same = F.col("strand")
    moved = {
        "lhs_begin": F.col("lhs_begin") + F.when(same, r_head).otherwise(r_tail), "lhs_end": F.col("lhs_end") - F.when(same, r_tail).otherwise(r_head),
        "rhs_begin": F.col("rhs_begin") + F.when(same, l_head).otherwise(l_tail), "rhs_end": F.col("rhs_end") - F.when(same, l_tail).otherwise(l_head),
    }
    joined = with_piles(overlaps, piles).where(meets).withColumns(moved).where(meets)
    cut = joined.withColumns({"lhs_begin": F.greatest("lhs_begin", "lb"), "lhs_end": F.least("lhs_end", "le"), "rhs_begin": F.greatest("rhs_begin", "rb"), "rhs_end": F.least("rhs_end", "re")})
    return cut.where((span("lhs") >= MIN_SPAN) & (span("rhs") >= MIN_SPAN))


def overlap_kind() -> Column:
    """0 internal, 1 lhs contained, 2 rhs contained, 3 lhs to rhs, 4 rhs to lhs, of overlaps with lb, le, rb, re. Equal
    extents count as lhs contained."""
    same, n_l, n_r = F.col("strand"), F.col("le") - F.col("lb"), F.col("re") - F.col("rb")
    l_b, l_e = F.col("lhs_begin") - F.col("lb"), F.col("lhs_end") - F.col("lb")
    r_b = F.when(same, F.col("rhs_begin") - F.col("rb")).otherwise(n_r - (F.col("rhs_end") - F.col("rb")))
    r_e = F.when(same, F.col("rhs_end") - F.col("rb")).otherwise(n_r - (F.col("rhs_begin") - F.col("rb")))
    l_rest, r_rest = n_l - l_e, n_r - r_e
    hang = F.least(l_b, r_b) + F.least(l_rest, r_rest)
    internal = (l_e - l_b < (l_e - l_b + hang) * 0.875) | (r_e - r_b < (r_e - r_b + hang) * 0.875)
    return F.when(internal, 0).when((l_b <= r_b) & (l_rest <= r_rest), 1).when((r_b <= l_b) & (r_rest <= l_rest), 2).when(l_b > r_b, 3).otherwise(4).cast("long")


def classify(clipped: DataFrame) -> DataFrame:
    return clipped.withColumn("kind", overlap_kind())


def finalize(clipped: DataFrame) -> DataFrame:
    """Dovetails only: score becomes the kind, places become relative to the regions, a reversed rhs is turned round."""
    rows = classify(clipped).where(F.col("kind") >= 3)
    r_b, r_e, n_r = F.col("rhs_begin") - F.col("rb"), F.col("rhs_end") - F.col("rb"), F.col("re") - F.col("rb")
    return rows.select(
        "lhs_id", (F.col("lhs_begin") - F.col("lb")).alias("lhs_begin"), (F.col("lhs_end") - F.col("lb")).alias("lhs_end"),
        "rhs_id", F.when(F.col("strand"), r_b).otherwise(n_r - r_e).alias("rhs_begin"), F.when(F.col("strand"), r_e).otherwise(n_r - r_b).alias("rhs_end"),
        F.col("kind").alias("score"), "strand", (F.col("le") - F.col("lb")).alias("lhs_length"), n_r.alias("rhs_length"),
    )


def contained_reads(clipped: DataFrame, piles: DataFrame | None = None) -> DataFrame:
    """Distinct read_id that lie within another read. With piles, a container that may be chimeric does not count."""
    rows = classify(clipped).where(F.col("kind").isin(1, 2))
    inner = F.when(F.col("kind") == 1, F.col("lhs_id")).otherwise(F.col("rhs_id")).alias("read_id")
    outer = F.when(F.col("kind") == 1, F.col("rhs_id")).otherwise(F.col("lhs_id")).alias("outer_id")
    found = rows.select(inner, outer)
    if piles is not None:
        trusted = piles.where(~F.col("maybe_chimeric")).select(F.col("read_id").alias("outer_id"))
        found = found.join(trusted, "outer_id", "left_semi")
    return found.select("read_id").distinct()


def without_reads(overlaps: DataFrame, reads: DataFrame) -> DataFrame:
    """Overlaps none of whose reads is in `reads`."""
    ids = reads.select("read_id")
    return overlaps.join(ids.withColumnRenamed("read_id", "lhs_id"), "lhs_id", "left_anti").join(ids.withColumnRenamed("read_id", "rhs_id"), "rhs_id", "left_anti")


def longest_per_pair(overlaps: DataFrame) -> DataFrame:
    """One overlap of each pair of reads: the longest, ties by places."""
    order = Window.partitionBy("lhs_id", "rhs_id").orderBy(F.desc(overlap_length()), "lhs_begin", "rhs_begin", "lhs_end", "rhs_end", "strand")
    return overlaps.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def similar(pairs: DataFrame, left: str, right: str, least: float) -> DataFrame:
    """Pairs of sequences of at least this identity; 0 keeps all without comparing."""
    return pairs if least <= 0 else pairs.where(identity(F.col(left), F.col(right)) >= least)
