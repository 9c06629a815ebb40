"""Best-fit packing by the linear grouping scheme.

Documents become pieces of at most `capacity` tokens. The exact histogram of the pieces' lengths (at most `capacity`
numbers, whatever the corpus) goes to the driver, which plans the sequences: large lengths are rounded up within groups
of equal cardinality, the few sizes that are left are packed by configurations of least cost (column generation,
Gilmore and Gomory 1961), the actual lengths are put in the places of the rounded ones, and what is left, small lengths
above all, goes where it fits best (Fernandez de la Vega and Lueker 1981). Sequences of the same make-up are planned as
one class with a number, so the plan stays small; each piece finds its place by its length and its rank among the
pieces of that length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstrand.llm.common import cut, field, id_type, slices, table
from loomstrand.llm.tokens import encoder, tokenizer_path


@dataclass
class Bins:
    """`count` sequences that hold pieces of these lengths, in this order."""

    lengths: tuple[int, ...]
    count: int


def group_sizes(counts: dict[int, int], groups: int) -> dict[int, int]:
    """Rounded length: number of pieces, for groups of equal cardinality of the lengths in falling order; a group has the
    length of its longest piece. Where no more than `groups` lengths occur, each is its own group."""
    if len(counts) <= groups:
        return {x: counts[x] for x in sorted(counts, reverse=True)}
    each, out, room, rounded = -(-sum(counts.values()) // groups), {}, 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if room == 0:
                rounded, room = length, each
            n = min(left, room)
            out[rounded] = out.get(rounded, 0) + n
            left, room = left - n, room - n
    return out


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The multiset of sizes within the capacity of the largest value; of sizes over a quarter of it, so of three at most."""
    single = np.zeros(capacity + 1)  # the best value of one size within each room
    np.maximum.at(single, sizes, values)
    single = np.maximum.accumulate(single)
    room = capacity - sizes[:, None] - sizes[None, :]
    pair = np.where(room >= 0, values[:, None] + values[None, :] + single[np.maximum(room, 0)], -1.0)
    i, j = np.unravel_index(int(pair.argmax()), pair.shape)
    chosen = [int(i), int(j)] if pair[i, j] >= single[capacity] else [int(values.argmax())]
    left = capacity - int(sizes[chosen].sum())
    third = np.where(sizes <= left, values, -1.0)
    if third.max() > 1e-12:
        chosen.append(int(third.argmax()))
    pattern = [0] * len(sizes)
    for k in chosen:
        pattern[k] += 1
    return float(values[chosen].sum()), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000, close: float = 2e-4) -> list[tuple[list[int], int]]:
    """[(pattern, times)] that cover no more than the demand, from the linear programme of least sequences rounded down."""
    n, at, d = len(sizes), np.array(sizes), np.array(demand, float)
    patterns = [[capacity // s if j == k else 0 for j in range(n)] for k, s in enumerate(sizes)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    use = d * inverse.diagonal()
    for _ in range(rounds):
        value, pattern = best_pattern(inverse.sum(axis=0), at, capacity)
        if value <= 1 + close:  # the programme's optimum is nearer than this share
            break
        turn = sum(k * inverse[:, j] for j, k in enumerate(pattern) if k)
        ratio = np.where(turn > 1e-9, use / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(ratio.argmin())
        use = np.maximum(use - ratio[out] * turn, 0)
        use[out] = ratio[out]
        patterns[out] = pattern
        row = inverse[out] / turn[out]
        inverse = inverse - turn[:, None] * row[None, :]
        inverse[out] = row
    return [(patterns[k], int(use[k] + 1e-6)) for k in np.argsort(-use, kind="stable") if use[k] >= 1 - 1e-6]


class _Open:
    """Classes of open sequences by their room."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.by = capacity, [], {}

    def add(self, bins: Bins) -> None:
        room = self.capacity - sum(bins.lengths)
        if room not in self.by:
            bisect.insort(self.rooms, room)
            self.by[room] = []
        self.by[room].append(bins)

    def take(self, length: int) -> Bins | None:
        """A class of those with the least room that is enough."""
        k = bisect.bisect_left(self.rooms, length)
        if k == len(self.rooms):
            return None
        found = self.by[room := self.rooms[k]].pop()
        if not self.by[room]:
            del self.by[room], self.rooms[k]
        return found

    def place(self, length: int, count: int) -> None:
        """Best fit for `count` pieces of a length; new sequences where none has room."""
        while count:
            bins = self.take(length) or Bins((), count)
            fit = min((self.capacity - sum(bins.lengths)) // length, count)
            n = min(bins.count, count // fit)
            if bins.count > n and bins.lengths:
                self.add(Bins(bins.lengths, bins.count - n))
            self.add(Bins(bins.lengths + (length,) * fit, n))
            count -= n * fit

    def all(self) -> list[Bins]:
        return [b for room in self.rooms for b in self.by[room]]


def plan_sequences(counts: dict[int, int], capacity: int = 1024, groups: int = 128) -> list[Bins]:
    """Classes of sequences that hold exactly counts[length] pieces of each length (1 to capacity). Lengths over a
    quarter of the capacity are large."""
    rest = np.zeros(capacity + 1, np.int64)
    for x, n in counts.items():
        rest[x] += n
    open_ = _Open(capacity)
    if rest[capacity]:
        open_.add(Bins((capacity,), int(rest[capacity])))
        rest[capacity] = 0
    if large := {int(x): int(rest[x]) for x in np.flatnonzero(rest) if x > capacity // 4}:
        grouped = group_sizes(large, groups)
        for pattern, times in configurations(list(grouped), list(grouped.values()), capacity):
            slots = [x for x, k in zip(grouped, pattern, strict=True) for _ in range(k)]
            while times:
                lengths = substitute(slots, rest, capacity)
                if sum(lengths) < sum(slots):
                    break  # the lengths it was made for are used up; the rest is left to best fit
                need = {x: lengths.count(x) for x in lengths}
                run = min(times, *(int(rest[x]) // k for x, k in need.items()))
                open_.add(Bins(tuple(lengths), run))
                times -= run
                for x, k in need.items():
                    rest[x] -= k * run
    for x in np.flatnonzero(rest)[::-1]:
        open_.place(int(x), int(rest[x]))
    return open_.all()


def substitute(slots: list[int], rest: np.ndarray, capacity: int) -> list[int]:
    """Actual lengths for the rounded ones: the longest left that is no longer; for the last, the longest that fits."""
    lengths: list[int] = []
    room = capacity
    for k, rounded in enumerate(slots):
        most = room if k == len(slots) - 1 else min(room, rounded)
        for x in np.flatnonzero(rest[: most + 1])[::-1]:
            if rest[x] > lengths.count(x):
                lengths.append(int(x))
                room -= int(x)
                break
    return lengths


@dataclass
class Places:
    """For each piece length, runs of ranks with the first sequence and the offset in it."""

    keys: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, plan: list[Bins]) -> Places:
        rows, used, sequence = [], {}, 0
        for bins in plan:
            offset = 0
            for length in bins.lengths:
                rank = used.get(length, 0)
                rows.append((length, rank, sequence, offset))
                used[length] = rank + bins.count
                offset += length
            sequence += bins.count
        rows.sort()
        a = np.array(rows, np.int64).reshape(-1, 4)
        return cls((a[:, 0] << 44) + a[:, 1], a[:, 1], a[:, 2], a[:, 3])

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (lengths << 44) + ranks, "right") - 1
        return self.sequence[at] + ranks - self.first[at], self.offset[at]


def cut_pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, ids if wanted, and its task and rank in that among the
    pieces of its length. Only longer documents are cut, and only their first piece may be shorter."""
    schema = T.StructType([
        field("_id", id_type(df, id_col)), field("piece", T.IntegerType()), *(field(c, T.LongType()) for c in ("start", "length", "ids_crc32")),
        *([field("ids", T.BinaryType())] if with_ids else []), field("_task", T.IntegerType()), field("_rank", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        task, end, seen, encode = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes(), [0] * (capacity + 1), encoder(tokenizer).encode
        for batch in batches:
            for part in slices(batch, 2048):
                rows: list[list] = [[] for _ in schema.names]
                for key, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    ids += end
                    n = len(ids) // 4
                    at, piece = 0, 0
                    while at < n:
                        size = (n - at) % capacity or capacity
                        data = ids[4 * at : 4 * (at + size)]
                        for column, v in zip(rows, (key, piece, at, size, zlib.crc32(data), *([data] if with_ids else []), task, seen[size]), strict=True):
                            column.append(v)
                        seen[size] += 1
                        at, piece = at + size, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, arrow, strict=True)], schema=arrow)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian unsigned
    32-bit, if wanted). Every sequence holds at most `capacity` tokens and its offsets have no gap.

    Null and empty texts are pieces of the end id alone. Repeated rows are packed each for itself; an empty table gives
    no pieces. The pieces are written once to the shared folder, so that ranks stay as they are if executors are lost.
    """
    pieces = cut(cut_pieces(df, tokenizer, end_id, capacity, id_col, text_col, with_ids), "pieces")
    per_task = cut(pieces.groupBy("length", "_task").count(), "piece-counts")
    counts = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` rows
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    ranked = pieces.join(per_task.select("length", "_task", F.coalesce(before, F.lit(0)).alias("_before")), ["length", "_task"])
    places = Places.of(plan_sequences(counts, capacity))
    names = ["_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = T.StructType([pieces.schema[c] for c in names] + [field("sequence_id", T.LongType()), field("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            *rest, rank = batch.columns
            sequence, offset = places.find(rest[3].to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], schema=arrow)

    return ranked.select(*names, (F.col("_before") + F.col("_rank")).alias("_rank")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2)
