"""Similarity join on word shingles by a token-group matrix.

Documents of one shingle set are one class. Classes that resemble a common leader form groups, which are cut into blocks
of members of like size; for each block the union of its members' tokens is stored (the matrix: token x block). A class
is compared with a block only if the overlap of its tokens with that union reaches what a link to any member needs, and
only then the block is opened: its members are told apart by bounds, then by parity bitmaps, and what remains is
verified on the whole sets. No linked pair can fail a bound, so the join is exact.

Most classes never enter the matrix. Sets link only if 9 * overlap >= 4 * (n + n'), so a class needs 0.8 n tokens that
other classes have too. A first pass counts these for each class: tasks settle what their own documents share and send
every other token once, four bytes each, so that a token of a third of all documents is one entry of each task. Of
the classes that are left, tokens are ordered from the rarest, and the matrix holds prefixes only: two linked sets share
at least k = 1 + n // 8 of the n - ceil(0.8 n) + k rarest tokens of each (n: the smaller set). A passage that very many
documents share thus stands at the end of their orders, and no pair is made for it. Classes are first linked to the
leader of their group (of those that share a rare token, the one with the least of its own), so that large clusters of
near copies become one component at linear cost; after that only blocks of other components are asked, by the smaller
component.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstrand.llm.common import batch_words, cut, drop, field, id_type, mix, release, slices, table, window_hashes

BLOCK = 128  # members of a block, about
PART_TOKENS = 1 << 20  # tokens of a part of the first count, about: what one task holds at a time
BUCKET_CLASSES = 1 << 13  # classes whose counts one task sums at a time, about
CHUNK_TOKENS = 1 << 20  # tokens that a task settles among its own documents at a time, about
BROADCAST_ROWS = 200_000  # row handles (24 bytes each) up to which texts are picked by a broadcast; beyond, by a shuffle
SLICE = 256  # texts that stand in Python at a time


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The distinct shingles (64-bit hashes, ascending) of each text: of its words with A-Z in lower case; a text of
    fewer words, but not none, has one shingle."""
    words, bounds = batch_words(texts, lower=True)
    windows = window_hashes(words, size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        elif b > a:
            out.append(mix(window_hashes(words[a:b], b - a) ^ np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def class_key(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


TOKENS = T.StructType([field("token", T.LongType()), field("c", T.LongType()), field("n", T.LongType())])
DEALT = T.StructType([field("part", T.IntegerType()), *(field(k, T.BinaryType()) for k in ("classes", "counts", "tokens", "several"))])
BUCKETS = T.StructType([field("bucket", T.IntegerType()), field("classes", T.BinaryType()), field("counts", T.BinaryType())])
COUNTS = T.StructType([field("c", T.LongType()), field("s", T.LongType())])
SETS = T.StructType([field("c", T.LongType()), field("tokens", T.BinaryType())])
SKETCHES = T.StructType([field("c", T.LongType()), field("bits", T.BinaryType())])
PAIRS = T.StructType([field("a", T.LongType()), field("b", T.LongType())])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        yield from slices(batch, SLICE)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        sets = shingle_sets(part.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) for s in sets], pa.int64())], names=["id", "h", "n", "c"])


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(classes, sets) of up to about CHUNK_TOKENS tokens, each class once for as long as a task remembers it."""
    seen: set[int] = set()
    classes: list[int] = []
    sets: list[np.ndarray] = []
    total = 0
    for part in _slices(batches):
        if len(seen) > 1_000_000:
            seen.clear()
        for s in shingle_sets(part.column(0).to_pylist()):
            if len(s) and (c := class_key(s)) not in seen:
                seen.add(c)
                classes.append(c)
                sets.append(s)
                total += len(s)
        if total >= CHUNK_TOKENS:
            yield classes, sets
            classes, sets, total = [], [], 0
    if classes:
        yield classes, sets


def _deal(parts: int):
    """Each chunk's tokens by part: those of one class as four bytes each, in the order of the classes with their
    counts; those of several classes once. How many tokens of each class were settled here goes out as a row of its own."""

    def row(part: int, classes: np.ndarray, counts: np.ndarray, tokens: np.ndarray, several: np.ndarray) -> tuple:
        return part, classes.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), tokens.astype("<u4").tobytes(), several.astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        for classes, sets in _unseen(batches):
            names, tokens = np.array(classes, np.int64), np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
            alone = new & np.concatenate((new[1:], [True]))
            out = []
            settled = np.bincount(owner[~alone], minlength=len(names))
            met = np.flatnonzero(settled)
            if len(met):
                out.append(row(int(names[0]) % parts, names[met], settled[met], none, none))
            part = (((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(part, np.arange(parts + 1)) if parts <= len(part) else None
            held = np.unique(part).tolist()
            for p in held:
                a, b = (edges[p], edges[p + 1]) if edges is not None else np.searchsorted(part, (p, p + 1))
                one, start = alone[a:b], new[a:b]
                mine = np.sort(owner[a:b][one].astype(np.uint64) << np.uint64(32) | tokens[a:b][one] & np.uint64(0xFFFFFFFF))
                whose, counts = np.unique((mine >> np.uint64(32)).astype(np.int64), return_counts=True)
                out.append(row(p, names[whose], counts, mine & np.uint64(0xFFFFFFFF), tokens[a:b][start & ~one] & np.uint64(0xFFFFFFFF)))
            for at in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array(v, f) for v, f in zip(zip(*out[at : at + 512], strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=DEALT.names)

    return run


def _shared(held: list[tuple[bytes, ...]], buckets: int) -> pa.RecordBatch:
    """Of one part, how many tokens of each class another class has, by bucket of classes."""
    names, counts, tokens, several = (np.concatenate([np.frombuffer(x[k], kind) for x in held]) for k, kind in enumerate(("<i8", "<u4", "<u4", "<u4")))
    settled = np.concatenate([np.full(len(x[1]) // 4, not x[2] and not x[3]) for x in held])
    owner = np.repeat(np.flatnonzero(~settled), counts[~settled])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, np.int64)
    number = counts.astype(np.int64) * settled
    if len(start):
        of = names[owner]
        shared = (np.minimum.reduceat(of, start) != np.maximum.reduceat(of, start)) | np.isin(tokens[start], several)
        number += np.bincount(owner[np.repeat(shared, np.diff(np.append(start, len(tokens))))], minlength=len(names))
    some = np.flatnonzero(number)
    bucket = (mix(names[some].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    some, bucket = some[order], bucket[order]
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(some)] if len(some) else [0]
    cuts = list(zip(edges, edges[1:], strict=False))
    names, number = names[some].astype("<i8"), number[some].astype("<u4")
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), *(pa.array([v[a:b].tobytes() for a, b in cuts], pa.binary()) for v in (names, number))], names=BUCKETS.names)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows, without the first column, of each of its values; rows come in its order."""
    last, held = None, []
    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(tuple(row))
    if held:
        yield held


def _meet(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches):
            yield _shared(held, buckets)

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each bucket's classes."""
    for held in _groups(batches):
        names, numbers = (np.concatenate([np.frombuffer(x[k], kind) for x in held]) for k, kind in enumerate(("<i8", "<u4")))
        classes, which = np.unique(names, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(np.bincount(which, numbers).astype(np.int64))], names=COUNTS.names)


def shared_counts(texts: DataFrame, tokens: int, classes: int) -> DataFrame:
    """(c, s): of the classes of the texts, how many of their tokens another class has; never too few. (A collision of
    what is sent of tokens, or a class that several tasks met, makes it too many.)"""
    parts, buckets = max(1, -(-tokens // PART_TOKENS)), max(1, -(-classes // BUCKET_CLASSES))
    dealt = texts.mapInArrow(_deal(parts), DEALT).repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(_meet(buckets), BUCKETS).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_total, COUNTS)


def _sets_of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, set) of each row whose text is of class c."""
    for part in _slices(batches):
        found = [(c, s.tobytes()) for c, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist()), strict=True) if class_key(s) == c]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=SETS.names)


def _tokens_of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        sets = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
        sizes = np.array([len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes))], names=TOKENS.names)


def sketch(tokens: np.ndarray) -> bytes:
    """A bitmap of at least twice as many bits as tokens (a power of two): for each bit whether an odd number of tokens
    falls on it. Two such differ in no more bits than the sets do in tokens; a longer one folds to a shorter one."""
    size = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sketch(np.frombuffer(x, np.uint64)) for x in part.column(1).to_pylist()], pa.binary())], names=SKETCHES.names)


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0) if len(bits) > size else bits


def differ(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of opened blocks that the asking class may link with, by sizes, shared tokens and sketches."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            a, b = [], []
            for c, n, s, size, comp, bits, members in zip(*(x.to_pylist() for x in batch.slice(at, SLICE).columns), strict=True):
                for m in members:
                    if (size, comp) < (m["size"], m["comp"]) and 9 * min(s, m["s"]) >= 4 * (n + m["n"]) and 9 * differ(bits, m["bits"]) <= n + m["n"]:
                        a.append(c)
                        b.append(m["c"])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=PAIRS.names)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        keep = pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=PAIRS.names)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    left, right = (sets.select(F.col("c").alias(k), F.col("tokens").alias(f"of_{k}")) for k in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(_verified, PAIRS)


def whole_sets(rows: DataFrame, docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(c, tokens) of the classes that have enough tokens in common with others, from one text of each."""
    reps = docs.where("n > 0").groupBy("c", "n").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("row"))
    alive = cut(reps.join(counts, "c").where("5 * s >= 4 * n").select("c", F.col("row.id").alias("rep"), F.col("row.h").alias("rep_h")), "alive")
    pick = F.broadcast(alive) if alive.count() <= BROADCAST_ROWS else alive
    found = rows.join(pick, rows["id"].eqNullSafe(pick["rep"]) & (rows["h"] == pick["rep_h"])).select("c", "text").mapInArrow(_sets_of_class, SETS)
    return cut(found.groupBy("c").agg(F.first("tokens").alias("tokens")), "sets")


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, c, n, s): the rarest tokens of each class of n tokens, s of which another of these classes has too."""
    tokens = sets.mapInArrow(_tokens_of_sets, TOKENS)
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(often, "token").groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("list")).withColumn("s", F.size("list").cast("long")).where("5 * s >= 4 * n")
    length = F.least(F.col("n"), F.col("n") - F.ceil(4 * F.col("n") / 5) + least_overlap(F.col("n"))) - (F.col("n") - F.col("s"))  # its own tokens come first
    return cut(ordered.select(F.explode(F.slice("list", F.lit(1), F.greatest(F.lit(0), length).cast("int"))).alias("t"), "c", "n", "s").select("t.token", "c", "n", "s"), "prefixes")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(c, comp): the least vertex that each vertex of the edges (a, b) reaches. Labels spread along edges and then jump
    to their label's label, so that rounds are few; each round is written to the shared folder."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "c"), name)
    while True:
        jump = labels.select(F.col("c").alias("comp"), F.col("comp").alias("next"))
        near = both.join(labels.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "c"), "c").select("c", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        new = cut(spread.join(jump, "comp", "left").select("c", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")), name)
        drop(labels)
        labels = new
        if new.where(F.col("comp") != F.col("old")).isEmpty():
            drop(both)
            found = labels.select("c", "comp")
            found.written_at = labels.written_at
            return found


def least_overlap(n: Column) -> Column:
    return F.lit(1) + F.floor(n / 8)


def may_link(n: str, s: str, n_other: str, s_other: str) -> Column:
    """Whether sets of n tokens, s of which others have, may link: 9 * overlap >= 4 * (n + n')."""
    return 9 * F.least(F.col(s), F.col(s_other)) >= 4 * (F.col(n) + F.col(n_other))


def leaders(prefix: DataFrame) -> DataFrame:
    """(c, n, s, b, n_b, s_b): for each class the leader, another one if there is any, with which it shares most tokens of prefixes."""
    lead = prefix.groupBy("token").agg(F.max_by(F.struct(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("s").alias("s_b")), F.struct(F.col("s") / F.col("n"), "n", "c")).alias("lead"))
    met = prefix.join(lead, "token").groupBy("c", "n", "s", "lead").count()
    return met.groupBy("c", "n", "s").agg(F.max_by("lead", F.struct(F.col("lead.b") != F.col("c"), "count", "lead")).alias("lead")).select("c", "n", "s", "lead.*")


def blocks_of(best: DataFrame, comps: DataFrame) -> DataFrame:
    """(c, n, s, size, comp, block): members of a group (a component, or the classes of one leader) of like sizes and
    shares, dealt to blocks of about BLOCK."""
    sizes = comps.groupBy("comp").agg(F.count("*").alias("size"))
    member = best.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c")).join(sizes, "comp", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    member = member.withColumn("group", F.when(F.col("size") > 1, F.col("comp")).otherwise(F.col("b"))).withColumn("cell", F.xxhash64("group", F.floor(F.log(F.col("n")) * 20), F.floor(F.col("s") / F.col("n") * 100)))
    crowd = member.groupBy("cell").agg(F.count("*").alias("crowd"))
    dealt = F.xxhash64("cell", F.pmod(F.xxhash64("c"), F.ceil(F.col("crowd") / BLOCK)))
    return member.join(crowd, "cell").select("c", "n", "s", "size", "comp", dealt.alias("block"))


def cross_pairs(prefix: DataFrame, member: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different components that pass the bounds of the token-group matrix."""
    rank = F.struct("size", "comp")
    block = member.groupBy("block").agg(F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.max("s").alias("s_high"), F.max(rank).alias("rank_b"))
    rows = prefix.select("token", "c").join(member.select("c", "block", "n", "s", rank.alias("rank")), "c")
    several = rows.groupBy("token").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("low != high")
    rows = cut(rows.join(several.select("token", "high"), "token"), "cross-tokens")
    matrix = rows.select("token", "block").distinct().join(block, "block")
    near = (F.col("rank") < F.col("rank_b")) & (5 * F.col("n") >= 4 * F.col("n_low")) & (4 * F.col("n") <= 5 * F.col("n_high")) & may_link("n", "s", "n_low", "s_high")
    met = rows.where("rank < high").select("token", "c", "n", "s", "rank").join(matrix, "token").where(near).groupBy("c", "block", "n", "n_low").count()
    opened = cut(met.where(F.col("count") >= least_overlap(F.least("n", "n_low"))).select("c", "block"), "opened")
    sketches = cut(sets.mapInArrow(_sketches, SKETCHES).join(member, "c"), "sketches")
    wanted = sketches.join(opened.select("block").distinct(), "block", "left_semi")
    listed = wanted.groupBy("block").agg(F.collect_list(F.struct("c", "n", "s", "size", "comp", "bits")).alias("members"))
    asked = opened.join(sketches.drop("block"), "c").join(listed, "block").select("c", "n", "s", "size", "comp", "bits", "members")
    pairs = cut(asked.mapInArrow(_opened, PAIRS), "cross-pairs")
    drop(rows, opened, sketches)
    return pairs


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the least id that links reach, its own included).

    Sets link when 100 * intersection >= 80 * union, on 64-bit hashes of five-word shingles. Null and empty texts and
    texts without a word have no shingles and link with nothing: their component is their own id. Rows of one set are
    linked whatever their ids; rows with a null id link as others do, but name no component (null where none of the
    component has an id). An empty table gives no rows. Ids may be of any type that has an order.
    """
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    kind = id_type(df, id_col)
    docs = cut(rows.mapInArrow(_classes, T.StructType([field("id", kind), *(field(k, T.LongType()) for k in ("h", "n", "c"))])), "classes")
    total, texts = docs.agg(F.sum("n"), F.count("*")).first()
    sets = whole_sets(rows, docs, shared_counts(rows.select("text"), total or 0, texts))
    prefix = prefixes(sets)
    best = cut(leaders(prefix), "leaders")
    star = best.where(F.col("c") != F.col("b")).where(may_link("n", "s", "n_b", "s_b")).select(F.col("c").alias("a"), "b")
    first = cut(verify(star, sets), "star-links")
    comps = components(first, "star-components")
    member = cut(blocks_of(best, comps), "members")
    pairs = cross_pairs(prefix, member, sets)
    second = cut(verify(pairs, sets), "cross-links")
    if not second.isEmpty():
        drop(comps)
        comps = components(first.unionByName(second), "components")
    drop(sets, prefix, best, first, member, pairs, second)
    reps = docs.where("n > 0").groupBy("c").agg(F.min("id").alias("least"))
    named = reps.join(comps, "c").select("c", "comp", "least")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_class = reps.join(named.join(least, "comp").select("c", "component_id"), "c", "left").select("c", F.coalesce("component_id", "least").alias("component_id"))
    out = docs.where("n > 0").join(by_class, "c").select("id", "n", "component_id").unionByName(docs.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with their columns, that have the least id of their component, one row of each id and text; rows
    without an id stay."""
    joined = jaccard_join(df, id_col, text_col)
    keep = joined.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    rows = df.join(keep, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return rows.unionByName(df.where(F.col(id_col).isNull()))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with recursive d as (select row_number() over () rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) ws from documents),
s as (select distinct rid, g from (select rid, array_to_string(list_slice(ws, k.i, k.i + 4), ' ') g from d, unnest(range(1, greatest(2, len(ws) - 3))) k(i) where len(ws) > 0)),
n as (select rid, count(*) n from s group by rid),
p as (select a.rid x, b.rid y, count(*) c from s a join s b using (g) where a.rid <> b.rid group by 1, 2),
l as (select x, y from p join n nx on x = nx.rid join n ny on y = ny.rid where 100 * c >= 80 * (nx.n + ny.n - c)),
r as (select x, x y from (select distinct x from l) union select r.x, l.y from r join l on r.y = l.x)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, coalesce(min(o.doc_id), d.doc_id) component_id
from d left join n using (rid) left join r on r.x = d.rid left join d o on o.rid = r.y group by d.rid, d.doc_id, n.n
"""
