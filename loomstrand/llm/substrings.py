"""Removal of repeated passages by keys of word windows, dealt as the leaves of prefix-partitioned suffix trees.

Suffixes are cut at `window` words, since a passage of that length decides. They are dealt to groups by variable-length
prefixes: boundaries in the order of suffixes, each cut to the shortest prefix that tells it from the one before, chosen
on a bounded sample so that groups fit in memory. Within its group equal keys are the windows that occur more than once;
common prefixes of neighbours are not computed, and neither are maximal repeats. A window's smallest document keeps its
occurrence, the others lose theirs; what a document loses is the union of such windows.

Three exact devices keep the shuffles small. Whole copies of a text with a smaller id lose all, and enter no tree. A suffix only enters a tree if its anchor (the least hash of a run of words
in its window) also occurs in another document; equal windows have equal anchors. And each task first settles what it
can among its own documents, so that a passage in a third of all documents sends a few suffixes from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstrand.llm.common import batch_words, field, flags_to_spans, hash_sample, slices, table, window_hashes

#: Words of documents that a task settles among themselves at a time.
CHUNK_WORDS = 1 << 20
GROUP_SUFFIXES = 1 << 18


def anchors_of(words: np.ndarray, window: int, run: int) -> np.ndarray:
    """For each window, the least hash of its runs of words."""
    runs = window_hashes(words, run)
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least = runs[:n].copy()
    for j in range(1, window - run + 1):
        np.minimum(least, runs[j : j + n], out=least)
    return least


def suffix_keys(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit number for each window, which together tell windows apart: the first has leading bits of the
    first and second word, in whose order suffixes stand, and all else is a hash of the whole window."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    whole, more = window_hashes(words, window), window_hashes(words, window, 0x9FB21C651E98DF25)
    first = (words[:n] >> np.uint64(44)) << np.uint64(44)
    first |= (words[1 : n + 1] >> np.uint64(48)) << np.uint64(28)
    first |= whole >> np.uint64(36)
    return first, (more >> np.uint64(32)).astype(np.uint32).view(np.int32)


def prefix_boundaries(sample: np.ndarray, groups: int) -> np.ndarray:
    """Ascending first keys of the groups, each the shortest prefix (in bits) that is above the boundary before."""
    ordered = np.sort(sample)
    picked = np.unique(ordered[np.linspace(0, len(ordered) - 1, groups + 1).astype(int)[1:-1]]) if len(ordered) else ordered
    out: list[int] = []
    for b in picked.tolist():
        low = out[-1] if out else 0
        bits = next((k for k in range(1, 65) if (b >> 64 - k << 64 - k) > low), 64)
        if (cut_ := b >> 64 - bits << 64 - bits) > low:
            out.append(cut_)
    return np.array(out, np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list[list], np.ndarray, np.ndarray]]:
    """(columns' values, word hashes, bounds) of documents with up to about CHUNK_WORDS words; column 1 has the text."""
    rows: list[list] = [[] for _ in range(columns)]
    parts, bounds, total = [], [0], 0
    for batch in batches:
        for part in slices(batch, 256):
            values = [c.to_pylist() for c in part.columns]
            words, b = batch_words(values[1])
            for column, v in zip(rows, values, strict=True):
                column += v if column is not rows[1] else [None] * len(v)
            parts.append(words)
            bounds += (b[1:] + total).tolist()
            total += len(words)
            if total >= CHUNK_WORDS:
                yield rows, np.concatenate(parts), np.array(bounds)
                rows, parts, bounds, total = [[] for _ in range(columns)], [], [0], 0
    if len(bounds) > 1:
        yield rows, np.concatenate(parts), np.array(bounds)


def _starts(bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words of all windows that lie within one document, the documents' numbers)"""
    size = np.maximum(np.diff(bounds) - window + 1, 0)
    doc = np.repeat(np.arange(len(size)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + bounds[doc], doc


def _by_owner(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(ids, each once; the little-endian 64-bit places of each, ascending)"""
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order].astype("<i8")
    cuts_ = np.flatnonzero(np.diff(ids)) + 1
    return ids[np.concatenate(([0], cuts_))], pa.array([x.tobytes() for x in np.split(places, cuts_)], pa.binary())


ANCHORS = T.StructType([field("k", T.LongType()), field("id", T.LongType()), field("known", T.BinaryType())])
SHARED = T.StructType([field("id", T.LongType()), field("anchors", T.BinaryType())])
LEAVES = T.StructType([field("g", T.IntegerType()), field("w1", T.LongType()), field("w2", T.IntegerType()), field("id", T.LongType()), field("pos", T.LongType()), field("settled", T.BinaryType())])
FOUND = T.StructType([field("id", T.LongType()), field("pos", T.BinaryType())])


def _list_anchors(window: int, run: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, _), words, bounds in _chunks(batches, 2):
            at, doc = _starts(bounds, window)
            if not len(at):
                continue
            least = anchors_of(words, window, run)[at]
            key, ids_of = np.array(ids, np.int64), np.array(ids, np.int64)[doc]
            order = np.lexsort((ids_of, least))
            least, ids_of, doc = least[order], ids_of[order], doc[order]
            new = np.concatenate(([True], (least[1:] != least[:-1]) | (ids_of[1:] != ids_of[:-1])))
            least, ids_of, doc = least[new], ids_of[new], doc[new]
            first = np.concatenate(([True], least[1:] != least[:-1]))
            group = np.cumsum(first) - 1
            shared = np.bincount(group)[group] > 1
            send = first  # one row for each anchor; if several documents here have it, these are settled
            yield pa.RecordBatch.from_arrays([pa.array(least[send].view(np.int64)), pa.array(ids_of[send]), pa.nulls(int(send.sum()), pa.binary())], names=ANCHORS.names)
            if shared.any():
                by = np.argsort(doc[shared], kind="stable")
                docs, lists = doc[shared][by], least[shared][by]
                cuts_ = np.flatnonzero(np.diff(docs)) + 1
                owners = key[docs[np.concatenate(([0], cuts_))]]
                yield pa.RecordBatch.from_arrays([pa.array(owners * 2654435761 % (1 << 62)), pa.array(owners), pa.array([x.tobytes() for x in np.split(lists, cuts_)], pa.binary())], names=ANCHORS.names)

    return each


def _share_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of anchors, then ids, those whose anchor several ids have; settled lists pass."""
    last: tuple[int, int, bool] | None = None  # anchor, id, sent
    for batch in batches:
        known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        if known.any():
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(known)), batch.column(2).filter(pa.array(known))], names=SHARED.names)
        keys, ids = batch.column(0).to_numpy()[~known], batch.column(1).to_numpy()[~known]
        if not len(keys):
            continue
        new = np.concatenate(([last is None or keys[0] != last[0]], keys[1:] != keys[:-1]))
        starts = np.flatnonzero(np.concatenate(([True], new[1:])))
        group = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(keys)]))))
        several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
        head = (np.empty(0, np.int64),) * 2
        if not new[0]:  # the group goes on from the batch before
            several[0] |= last[2] or ids[0] != last[1]
            if several[0] and not last[2]:
                head = np.array([last[0]]), np.array([last[1]])
        send = several[group]
        last = (int(keys[-1]), int(ids[-1]), bool(several[-1]))
        out_k, out_i = np.concatenate((head[0], keys[send])), np.concatenate((head[1], ids[send]))
        if len(out_k):
            flat = out_k.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(out_i), pa.array([flat[8 * k : 8 * k + 8] for k in range(len(out_k))], pa.binary())], names=SHARED.names)


def _list_leaves(window: int, run: int, boundaries: np.ndarray):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, _, shared, texts), words, bounds in _chunks(batches, 4):
            at, doc = _starts(bounds, window)
            if not len(at):
                continue
            lists = [np.frombuffer(b"".join(x), np.uint64) for x in shared]
            first, second, least = *suffix_keys(words, window), anchors_of(words, window, run)
            keep = np.zeros(len(at), bool)
            edges = np.searchsorted(doc, np.arange(len(ids) + 1))
            for d, anchors in enumerate(lists):
                keep[edges[d] : edges[d + 1]] = np.isin(least[at[edges[d] : edges[d + 1]]], anchors)
            at, doc = at[keep], doc[keep]
            if not len(at):
                continue
            w1, w2, key = first[at], second[at], np.array(ids, np.int64)
            order = np.lexsort((at, key[doc], w2, w1))
            w1, w2, at, doc = w1[order], w2[order], at[order], doc[order]
            new = np.concatenate(([True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
            owner = key[doc][np.flatnonzero(new)][np.cumsum(new) - 1]
            lost = key[doc] > owner
            pos = (np.array(texts, np.int64)[doc] << 32) | (at - bounds[doc])
            stay = np.flatnonzero(~lost)
            stay = stay[np.argsort(at[stay])]  # in the order of the texts, in which ids and places compress well
            group = np.searchsorted(boundaries, w1[stay], "right").astype(np.int32)
            n = len(stay)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array((w1[stay] ^ np.uint64(1 << 63)).view(np.int64)), pa.array(w2[stay]), pa.array(key[doc[stay]]), pa.array(pos[stay]), pa.nulls(n, pa.binary())], names=LEAVES.names)
            if lost.any():
                owners, lists = _by_owner(key[doc[lost]], pos[lost])
                yield pa.RecordBatch.from_arrays([pa.array((-1 - owners % 1_000_003).astype(np.int32)), pa.nulls(len(owners), pa.int64()), pa.nulls(len(owners), pa.int32()), pa.array(owners), pa.nulls(len(owners), pa.int64()), lists], names=LEAVES.names)

    return each


def _deep_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the leaves of subtrees in order, those under an internal node at full depth whose document is not the node's
    smallest. Rows of settled positions pass."""
    node: tuple[int, int, int] | None = None  # w1, w2, smallest id
    for batch in batches:
        settled = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
        if settled.any():
            mask = pa.array(settled)
            yield pa.RecordBatch.from_arrays([batch.column(3).filter(mask), batch.column(5).filter(mask)], names=FOUND.names)
        if settled.all():
            continue
        rows = batch.filter(pa.array(~settled))
        w1, w2, ids, pos = (rows.column(k).to_numpy() for k in (1, 2, 3, 4))
        new = np.concatenate(([node is None or (int(w1[0]), int(w2[0])) != node[:2]], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
        smallest = ids[np.flatnonzero(new)] if new[0] else np.concatenate(([node[2]], ids[np.flatnonzero(new)]))
        of = smallest[np.cumsum(new) - (1 if new[0] else 0)]
        lost = ids > of
        node = (int(w1[-1]), int(w2[-1]), int(of[-1]))
        if lost.any():
            owners, lists = _by_owner(ids[lost], pos[lost])
            yield pa.RecordBatch.from_arrays([pa.array(owners), lists], names=FOUND.names)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, run: int = 6, sample_docs: int = 400) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces), kept_text, and
    removed_spans (the union of the windows removed, as [start, end) word spans; spans that abut are one).

    Words are runs of other than ASCII white space. A word goes if a window of `window` words that covers it also starts
    in a document with a smaller id; windows are judged on the input. Ids must be integers; a row without one keeps all
    its words and takes none from others, rows of one id never take from each other, and null and empty texts have no
    words. An empty table gives no rows. Texts are read whole; the sample only places the groups' boundaries.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))  # a new name: else Spark strips the alias in one of two plans, and they share no exchange
    texts = [r[0] for r in hash_sample(rows.where("body is not null").withColumn("body", F.substring("body", 1, 50_000)), ["body"], sample_docs, "id")]
    total = rows.where("id is not null").count()
    words, bounds = batch_words(texts)
    at, _ = _starts(bounds, window)
    per_doc = len(at) / max(1, len(texts))
    boundaries = prefix_boundaries(suffix_keys(words, window)[0][at], int(min(1 << 16, max(4096, total * per_doc / GROUP_SUFFIXES))))

    named = rows.where("id is not null").withColumn("h", F.hash("body"))
    digests = named.where("body is not null").select("id", "h", F.unhex(F.md5("body")).alias("k"))
    firsts = digests.groupBy("k").agg(F.min("id").alias("least"))
    copies = digests.join(firsts, "k").where("id > least").groupBy("id").agg(F.collect_set("h").alias("copies"))
    dealt = named.repartition("id").join(copies, "id", "left").select("id", "body", "h", F.coalesce(F.array_contains("copies", F.col("h")), F.lit(False)).alias("copy"))
    single = dealt.where("not copy")
    anchors = single.select("id", "body").mapInArrow(_list_anchors(window, run), ANCHORS).repartition("k").sortWithinPartitions("k", "id").mapInArrow(_share_anchors, SHARED)
    shared = anchors.groupBy("id").agg(F.collect_list("anchors").alias("anchors"))
    leaves = single.join(shared, "id").select("id", "body", "anchors", "h").mapInArrow(_list_leaves(window, run, boundaries), LEAVES)
    found = leaves.repartition("g").sortWithinPartitions("w1", "w2", "id", "pos").mapInArrow(_deep_nodes, FOUND)
    per_id = found.groupBy("id").agg(F.collect_list("pos").alias("pos"))
    unnamed = rows.where("id is null").select("id", "body", F.hash("body").alias("h"), F.lit(False).alias("copy"), F.array().cast("array<binary>").alias("pos"))
    judged = dealt.join(per_id, "id", "left").select("id", "body", "h", "copy", "pos").unionByName(unnamed)
    spans = T.ArrayType(T.StructType([field("start", T.LongType()), field("end", T.LongType())]))
    schema = T.StructType([field("id", T.LongType()), field("n_words", T.LongType()), field("n_removed", T.LongType()), field("kept_sha256", T.StringType()), field("kept_text", T.StringType()), field("removed_spans", spans)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, 256):
                out: list[list] = [[] for _ in schema.names]
                for key, text, h, copy, lists in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    split = (text or "").encode("utf-8", "surrogatepass").split()
                    places = np.frombuffer(b"".join(lists or []), "<i8")
                    places = places[places >> 32 == h] & 0xFFFFFFFF  # rows of one id may differ in text
                    gone: list[tuple[int, int]] = []
                    kept = split
                    if copy and len(split) >= window:
                        gone, kept = [(0, len(split))], []
                    elif len(places):
                        begun = np.cumsum(np.bincount(places, minlength=len(split)))
                        flags = begun - np.concatenate((np.zeros(window, np.int64), begun[:-window])) > 0
                        gone = flags_to_spans(flags)
                        kept = list(compress(split, (~flags).tolist()))
                    joined = b" ".join(kept)
                    for column, v in zip(out, (key, len(split), len(split) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass"), [{"start": s, "end": e} for s, e in gone]), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)

    return judged.mapInArrow(finish, schema).withColumn("id", F.col("id").cast(df.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = r"""
with d as (select row_number() over () rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) ws from documents),
g as (select rid, doc_id, k.i, array_to_string(list_slice(ws, k.i, k.i + 12), ' ') g from d, unnest(range(1, len(ws) - 11)) k(i)),
m as (select rid, i from (select rid, i, doc_id, min(doc_id) over (partition by g) least from g) where doc_id > least),
c as (select distinct rid, i + k.j i from m, unnest(range(0, 13)) k(j)),
r as (select rid, list(i) gone from c group by rid)
select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(len(gone), 0) as bigint) n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda k: not list_contains(coalesce(gone, []), k)), lambda k: ws[k]), ' '), '')) kept_sha256
from d left join r using (rid)
"""
