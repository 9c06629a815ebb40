"""The inherently sequential part of pile annotation: one read's slopes and the regions that follow from them."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstrand.functions.columns import MIN_REGION_BINS
from loomstrand.operators.piles import CLUSTER_GAP, CLUSTER_SIZE, SLOPE_BINS

CAP = 65535
Slope = tuple[int, int, int]  # first bin, 0 down or 1 up, last bin


def _window_maxima(cov: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of the w places before and after each place; -1 where there is none."""
    padded = np.concatenate((np.full(w, -1), cov, np.full(w, -1)))
    views = np.lib.stride_tricks.sliding_window_view(padded, w).max(axis=1)
    return views[: len(cov)], views[w + 1 : w + 1 + len(cov)]


def raw_slopes(cov: np.ndarray, q: float, w: int = SLOPE_BINS) -> list[Slope]:
    if not len(cov):
        return []
    low = np.minimum(cov * q, CAP).astype(np.int64)
    before, after = _window_maxima(cov, w)
    found = []
    for kind, marks in ((0, before > low), (1, after > low)):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
        found += [(int(a), kind, int(b) - 1) for a, b in zip(edge[0::2], edge[1::2], strict=True)]
    return sorted(found)


def _runs(marks: np.ndarray, base: int, kind: int) -> list[Slope]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
    return [(base + int(a), kind, base + int(b) - 1) for a, b in zip(edge[0::2], edge[1::2], strict=True)]


def _resolved(slope: Slope, other: Slope, cov: np.ndarray, low: np.ndarray) -> list[Slope]:
    """What a slope that reaches into the next one becomes: its own part of the overlap is looked at anew, an up slope
    against what is ahead of each bin within the part, a down slope against what is behind."""
    first, kind, last = slope
    if kind:
        stop = min(last, other[2])
        ahead = np.maximum.accumulate(cov[first + 1 : stop + 1][::-1])[::-1]
        return [(stop, 1, last), *_runs(low[first:stop] < ahead, first, 1)]
    begin = max(first, other[0])
    behind = np.maximum.accumulate(cov[begin : last + 1])
    return [(first, 0, begin), *_runs(np.concatenate(([False], behind[:-1] > low[begin + 1 : last + 1])), begin, 0)]


def separated(slopes: list[Slope], cov: np.ndarray, low: np.ndarray) -> list[Slope]:
    """Slopes in order, none reaching into the next one. All that a slope is resolved into begins where it does or
    later, so the slopes before it stay as they are, and one sweep over a heap settles all."""
    heap, out = list(set(slopes)), []
    heapify(heap)
    while heap:
        slope = heappop(heap)
        while heap and heap[0] == slope:
            heappop(heap)
        if heap and slope[2] >= heap[0][0] + (slope[1] == 0):  # a down slope may touch the next one
            parts = _resolved(slope, heap[0], cov, low)
            if slope not in parts:
                for part in parts:
                    heappush(heap, part)
                continue
        out.append(slope)
    return out


def find_slopes(cov: np.ndarray, q: float) -> list[Slope]:
    """Slopes of a coverage histogram, separated where they overlap and narrowed where an up slope meets a down slope."""
    low = np.minimum(cov * q, CAP)
    slopes = separated(raw_slopes(cov, q), cov, low)
    for i, (up, down) in enumerate(zip(slopes, slopes[1:], strict=False)):
        up = slopes[i]
        if (up[1], down[1]) == (1, 0) and 1 < down[0] - up[2] <= SLOPE_BINS:
            under = low < cov[up[2] + 1 : down[0]].max()
            rises, falls = np.flatnonzero(under[up[0] : up[2] + 1]), np.flatnonzero(under[down[0] : down[2] + 1])
            slopes[i] = up[0], 1, up[0] + int(rises[-1] if len(rises) else 0)
            slopes[i + 1] = int(down[0] + falls[0] if len(falls) else down[2]), 0, down[2]
    return slopes


def merged(regions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(regions):
        if out and out[-1][1] > a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def chimeric_regions(cov: np.ndarray) -> list[tuple[int, int]]:
    slopes = find_slopes(cov, 1.82)
    return merged([(a[0], b[2]) for a, b in zip(slopes, slopes[1:], strict=False) if a[1] == 0 and b[1] == 1])


def cut_chimera(cov: np.ndarray, begin: int, end: int, regions: list[tuple[int, int]], median: int) -> tuple[int, int, bool, bool, list[tuple[int, int]]]:
    """(begin, end, invalid, chimeric, unresolved): the longest stretch between regions that fall under a 1.82th of the
    global median; the other regions stay unresolved."""
    within = [r for r in regions if begin <= r[0] and r[1] <= end]
    low = np.minimum(cov * 1.82, CAP) <= median
    falls = [bool(low[a : b + 1].any()) for a, b in within]
    edges = [begin, *chain.from_iterable(compress(within, falls)), end]
    best = max(zip(edges[0::2], edges[1::2], strict=True), key=lambda piece: piece[1] - piece[0])
    left = [r for r, down in zip(within, falls, strict=True) if not down]
    changed = best != (begin, end)
    if best[1] - best[0] < MIN_REGION_BINS:
        return begin, end, True, changed, left
    return *best, False, changed, left


def repetitive_regions(cov: np.ndarray, begin: int, end: int, median: int, marked: list[int]) -> list[tuple[int, int]]:
    """Regions of frequent k-mers and of coverage peaks between an up and a later down slope, merged and clipped."""
    bins = np.unique(np.array(marked, np.int64))
    clusters = np.split(bins, np.flatnonzero(np.diff(bins) > CLUSTER_GAP) + 1)
    found = [(int(c[0]), int(c[-1])) for c in clusters if len(c) > CLUSTER_SIZE]

    first, kind, last = np.array(find_slopes(cov, 1.42), np.int64).reshape(-1, 3).T
    place = np.arange(len(first))
    up, down = np.nonzero((kind[:, None] == 1) & (kind[None, :] == 0) & (place[:, None] < place[None, :]))
    near = (first[down] + last[down]) // 2 - (first[up] + last[up]) // 2 <= 0.84 * (end - begin)
    above = np.concatenate(([0], np.cumsum(cov > int(min(1.42 * median, CAP)))))
    inner = np.maximum(first[down] - last[up] - 1, 0)
    high = np.where(inner > 0, above[np.maximum(first[down], last[up] + 1)] - above[last[up] + 1], 0)
    peaks = near & (inner > 0) & (high >= 0.9 * (first[down] - last[up]))
    for u, d in zip(up[peaks], down[peaks], strict=True):
        edge = int(min(1.42 * max(int(cov[last[u]]), int(cov[first[d]])), CAP))
        if cov[last[u] + 1 : first[d]].max() > edge:
            found.append((int(last[u] - 0.336 * (last[u] - first[u])), int(first[d] + 0.336 * (last[d] - first[d]))))
    return [(max(begin, a), min(end, b)) for a, b in merged(found)]


REGION = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
ANNOTATED = T.StructType([T.StructField("read_id", T.LongType()), T.StructField("median", T.LongType()), T.StructField("chimeric", REGION)])


def _histogram(n: int, begins: list, ends: list, covs: list) -> np.ndarray:
    cov = np.zeros(n, np.int64)
    for a, b, c in zip(begins, ends, covs, strict=True):
        cov[max(a, 0) : max(min(b, n), 0)] = c
    return cov


def with_histograms(piles: DataFrame, runs: DataFrame) -> DataFrame:
    """piles (read_id, bins, begin, end, ...) with their coverage runs as arrays; a read's runs are bounded by its length."""
    packed = runs.groupBy("read_id").agg(F.collect_list("begin").alias("run_begin"), F.collect_list("end").alias("run_end"), F.collect_list("cov").alias("run_cov"))
    none = F.array().cast("array<long>")
    return piles.join(packed, "read_id", "left").withColumns({c: F.coalesce(c, none) for c in ("run_begin", "run_end", "run_cov")})


def map_histograms(rows: DataFrame, extra: list[str], schema: T.StructType, each) -> DataFrame:
    """each(read_id, coverage within [begin, end), begin, end, *extra) -> output row, for rows of with_histograms()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for read_id, bins, begin, end, rb, re, rc, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cov = _histogram(bins, rb, re, rc)
                cov[:begin] = 0
                cov[end:] = 0
                out.append(each(read_id, cov, begin, end, *rest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.select("read_id", "bins", "begin", "end", "run_begin", "run_end", "run_cov", *extra).mapInArrow(run, schema)


def as_rows(regions: list[tuple[int, int]]) -> list[dict]:
    return [{"first": a, "last": b} for a, b in regions]


def annotate(piles: DataFrame, runs: DataFrame) -> DataFrame:
    """(read_id, median, chimeric) of valid piles."""

    def each(read_id, cov, begin, end):
        inner = np.sort(cov[begin:end])
        return read_id, int(inner[len(inner) // 2]) if len(inner) else 0, as_rows(chimeric_regions(cov))

    return map_histograms(with_histograms(piles, runs), [], ANNOTATED, each)
