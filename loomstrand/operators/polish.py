"""Consensus: reads are placed on unitigs and each window of a unitig is put to a weighted vote."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstrand.functions.columns import reverse_complement
from loomstrand.operators.sketch import chain, drop_frequent, minimizers, seed_join

WINDOW = 500
VOTES = T.StructType([T.StructField("id", T.LongType()), T.StructField("window", T.LongType()), T.StructField("seq", T.StringType()), T.StructField("votes", T.LongType())])


def mean_quality(reads: DataFrame) -> DataFrame:
    """One row, mean_quality: the mean over all reads of each read's mean quality; reads without count as 0."""
    total = F.aggregate(F.transform(F.split("qual", ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x) - 33 * F.length("qual")
    mean = F.when(F.length("qual") > 0, total / F.length("qual")).otherwise(0.0)
    return reads.select(F.coalesce(mean, F.lit(0.0)).alias("q")).agg((F.sum("q") / F.count("*")).alias("mean_quality"))


def align_columns(ref: str, seq: str, match: int, mismatch: int, gap: int) -> list[str]:
    """For each letter of ref, what seq has there ('' for a gap; letters put in follow the letter before)."""
    a, b = np.frombuffer(ref.encode(), np.uint8), np.frombuffer(seq.encode(), np.uint8)
    n, m = len(a), len(b)
    steps = np.arange(m + 1) * gap
    table = np.zeros((n + 1, m + 1), np.int32)
    table[0] = steps
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int32)
        best[0] = i * gap
        best[1:] = np.maximum(table[i - 1, :-1] + np.where(b == a[i - 1], match, mismatch), table[i - 1, 1:] + gap)
        table[i] = np.maximum.accumulate(best - steps) + steps
    out, i, j, more = [""] * n, n, m, ""
    while i:
        if j and table[i, j] == table[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            out[i - 1] = chr(b[j - 1]) + more
            i, j, more = i - 1, j - 1, ""
        elif table[i, j] == table[i - 1, j] + gap:
            out[i - 1] = more
            i, more = i - 1, ""
        else:
            j, more = j - 1, chr(b[j - 1]) + more
    return out


def vote(ref: str, pieces: list[str], match: int = 3, mismatch: int = -5, gap: int = -4) -> str:
    """The commonest entry of each column; the reference has a vote, and wins ties."""
    columns = [dict.fromkeys([c], 1) for c in ref]
    for piece in pieces:
        for column, entry in zip(columns, align_columns(ref, piece, match, mismatch, gap), strict=True):
            column[entry] = column.get(entry, 0) + 1
    return "".join(max(c.items(), key=lambda x: (x[1], x[0] == r))[0] for c, r in zip(columns, ref, strict=True))


def polish_round(unitigs: DataFrame, reads: DataFrame, match: int = 3, mismatch: int = -5, gap: int = -4, most: int = 32, k: int = 15, w: int = 5) -> DataFrame:
    """unitigs (id, seq, ...) with seq voted by the reads (read_id, seq) that lie on them. Of each window, at most `most`
    pieces vote, by read id."""
    shift = int(unitigs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1
    both = unitigs.select(F.col("id").alias("read_id"), "seq").unionByName(reads.select((F.col("read_id") + shift).alias("read_id"), "seq"))
    sketch = drop_frequent(minimizers(both, k, w, canonical=True))
    hits = chain(seed_join(sketch.where(F.col("read_id") < shift), sketch.where(F.col("read_id") >= shift)), k)
    placed = hits.select(F.col("lhs_id").alias("id"), "lhs_begin", "lhs_end", (F.col("rhs_id") - shift).alias("read_id"), "rhs_begin", "rhs_end", "strand").join(reads.select("read_id", F.col("seq").alias("read")), "read_id")
    text = F.when(F.col("strand"), F.col("read")).otherwise(reverse_complement(F.col("read")))
    first = F.when(F.col("strand"), F.col("rhs_begin")).otherwise(F.length("read") - F.col("rhs_end"))
    windows = placed.select("id", "read_id", "lhs_begin", "lhs_end", text.alias("text"), first.alias("first"), (F.col("rhs_end") - F.col("rhs_begin")).alias("size"), F.explode(F.sequence(F.ceil(F.col("lhs_begin") / WINDOW), F.greatest(F.ceil(F.col("lhs_begin") / WINDOW), F.floor(F.col("lhs_end") / WINDOW) - 1))).alias("window"))
    scale = F.col("size") / (F.col("lhs_end") - F.col("lhs_begin"))
    a = (F.col("first") + F.floor((F.col("window") * WINDOW - F.col("lhs_begin")) * scale)).cast("int")
    pieces = windows.where((F.col("window") + 1) * WINDOW <= F.col("lhs_end")).select("id", "window", "read_id", F.substring("text", a + 1, F.floor(WINDOW * scale).cast("int")).alias("piece"))
    heard = pieces.groupBy("id", "window").agg(F.slice(F.sort_array(F.collect_list(F.struct("read_id", "piece"))), 1, most)["piece"].alias("pieces"))
    cut = unitigs.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.length("seq") - 1) / WINDOW), F.lit(0)))).alias("window"), "seq").select("id", "window", F.substring("seq", (F.col("window") * WINDOW + 1).cast("int"), F.lit(WINDOW)).alias("ref"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, x, vote(ref, said or [], match, mismatch, gap) if said else ref, len(said or [])) for i, x, ref, said in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=VOTES.names)

    voted = cut.join(heard, ["id", "window"], "left").select("id", "window", "ref", "pieces").mapInArrow(run, VOTES)
    joined = voted.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("window", "seq"))), lambda x: x["seq"]), "").alias("seq"), F.sum("votes").alias("votes"))
    return unitigs.drop("seq").join(joined, "id")
