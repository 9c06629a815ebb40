"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each task turns its documents, shard by shard, into word numbers of the benchmark's vocabulary, sorts the suffixes that
can hold a match into a suffix array (by their first window), and binary-searches every suffix of every benchmark item
in it. Suffixes shorter in known words than the shortest window cannot match and are left out, which is exact. A second
suffix array, of the matched windows only, extends each match to the longest verbatim one and gives its place.

The benchmark goes to the shared folder in blocks of bounded text, which tasks read there, one narrow pass each; the
documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstrand.llm.common import cut, drop, field, flags_to_spans, fresh_path, id_type, table

#: A-Z to lower case; every byte of [\x00-\x2F\x3A-\x60\x7B-\x7F] (after that) to a space.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def _spread(at: np.ndarray) -> np.ndarray:
    """Places for sorted numbers in a row, with one free place wherever the numbers do not follow each other."""
    return np.arange(len(at)) + np.concatenate(([0], np.cumsum(np.diff(at) > 1)))


def _table(values: np.ndarray) -> list[np.ndarray]:
    """Least values of all stretches of 1, 2, 4, ... values."""
    out, step = [values], 1
    while 2 * step <= len(values):
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
        step *= 2
    return out


class Extension:
    """How far matches of whole windows go on, from a suffix array of the shard's and the items' rows of window keys.

    Each stretch of adjoining matched windows is a row of keys; a free place, equal to nothing, ends it. Ranks of stretches
    of 1, 2, 4, ... keys sort the suffixes and compare any two of them.
    """

    def __init__(self, tests: Tests, at: np.ndarray, keys: np.ndarray):
        hit = np.zeros(len(tests.keys), bool)
        hit[keys] = True
        self.chosen = np.flatnonzero(hit[tests.key_of])
        a = _spread(at)
        b = _spread(tests.place[self.chosen]) + a[-1] + 2
        rank = len(tests.keys) + np.arange(b[-1] + 2)
        free = np.ones(len(rank), bool)
        free[a] = free[b] = False
        rank[a], rank[b] = keys, tests.key_of[self.chosen]
        most, step, self.ranks = int(np.diff(np.flatnonzero(free), prepend=-1).max()), 1, [rank]
        while step <= most:
            after = np.concatenate((rank[step:] + step, np.arange(step)[: len(rank)]))
            rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1]
            self.ranks.append(rank)
            step *= 2
        places = np.concatenate((a, b))
        order = np.argsort(rank[places])
        self.sorted, test, here = places[order], order >= len(a), np.arange(len(order))
        self.test = np.where(test, self.chosen[np.maximum(order - len(a), 0)], np.iinfo(np.int64).max)
        self.rank_of = np.empty(len(a), np.int64)
        self.rank_of[order[~test]] = here[~test]
        below = np.maximum.accumulate(np.where(test, here, -1))[self.rank_of]
        above = np.minimum.accumulate(np.where(test, here, len(order))[::-1])[::-1][self.rank_of]
        #: For each position the number of windows of the longest row of keys that it shares with an item.
        self.shared = np.zeros(len(a), np.int64)
        for near, there in ((below, below >= 0), (above, above < len(order))):
            self.shared[there] = np.maximum(self.shared[there], self._common(self.sorted[self.rank_of[there]], self.sorted[near[there]]))

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            out += (self.ranks[level][x + out] == self.ranks[level][y + out]).astype(np.int64) << level
        return out

    def least(self, which: np.ndarray) -> np.ndarray:
        """For each of these positions the first of the items' windows where its longest match begins."""
        heights, first = _table(self._common(self.sorted[:-1], self.sorted[1:])), _table(self.test)
        low, high, need = self.rank_of[which].copy(), self.rank_of[which].copy(), self.shared[which]
        for level in range(len(heights) - 1, -1, -1):
            step, t = 1 << level, heights[level]
            down = (low >= step) & (t[np.clip(low - step, 0, len(t) - 1)] >= need)
            low -= down * step
            up = (high + step < len(self.sorted)) & (t[np.minimum(high, len(t) - 1)] >= need)
            high += up * step
        out = np.empty(len(which), np.int64)
        level = np.frexp(high - low + 1)[1] - 1
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(first[k][low[m]], first[k][high[m] - (1 << k) + 1])
        return out


class Tests:
    """A block of benchmark items: the vocabulary and every suffix (window) with its places in the items, sorted."""

    def __init__(self, rows: list[tuple[str, str | None]], n: int):
        self.n, self.vocabulary = n, {}
        names, sizes, windows, item_of, start_of, place, at = {}, [], [], [], [], [], 0
        for item, text in sorted({(item, text) for item, text in rows if text is not None}):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], ">u4")
            if not len(ids):
                continue
            m = min(n, len(ids))
            count = len(ids) - m + 1
            made = np.zeros((count, n), ">u4")
            made[:, :m] = np.lib.stride_tricks.sliding_window_view(ids, m)
            windows.append(made)
            sizes.append(np.full(count, m))
            item_of.append(np.full(count, names.setdefault(item, len(names))))
            start_of.append(np.arange(count))
            place.append(at + np.arange(count))
            at += count + 1
        flat = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
        self.names, self.item_of, self.start_of, self.place = list(names), flat(item_of), flat(start_of), flat(place)
        raw = (np.concatenate(windows) if windows else np.empty((0, n))).astype(">u4")  # as concatenate forgets the order of bytes
        self.low, first, key_of = np.unique(raw.view(f"S{4 * n}").ravel(), return_index=True, return_inverse=True)
        self.keys, self.key_of = self.low, key_of.ravel().astype(np.int64)
        self.sizes = flat(sizes)[first]
        self.least = int(self.sizes.min()) if len(self.sizes) else n
        top = raw[first].copy()
        top[np.arange(n) >= self.sizes[:, None]] = 0xFFFFFFFF
        self.high = top.view(f"S{4 * n}").ravel()
        self.by_key = np.argsort(self.key_of, kind="stable")
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(self.key_of, minlength=len(self.keys)))))

    def items(self, key: int) -> list[str]:
        return [self.names[i] for i in np.unique(self.item_of[self.by_key[self.bounds[key] : self.bounds[key + 1]]])]

    def search(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, keys) of the test suffixes that occur in the shard."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(self.keys) or not len(numbers):
            return none
        gap = np.flatnonzero(numbers == 0)
        after = np.append(gap, len(numbers))[np.searchsorted(gap, np.arange(len(numbers)))]
        run = after - np.arange(len(numbers))
        at = np.flatnonzero(run >= self.least)
        if not len(at):
            return none
        padded = np.concatenate((numbers, np.zeros(self.n, numbers.dtype))).astype(">u4")
        rows = padded[at[:, None] + np.arange(self.n)]
        rows[np.arange(self.n) >= np.minimum(run[at], self.n)[:, None]] = 0
        suffixes = np.ascontiguousarray(rows).view(f"S{4 * self.n}").ravel()
        order = np.argsort(suffixes, kind="stable")
        suffix_array, ordered = at[order], suffixes[order]
        first, last = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        keys = np.flatnonzero(last > first)
        counts = (last - first)[keys]
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return suffix_array[np.repeat(first[keys], counts) + within], np.repeat(keys, counts)

    def longest(self, positions: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, the items' windows where they begin) of the matches that lie in no other match, in order."""
        whole = self.sizes[keys] == self.n
        order = np.argsort(positions[whole])
        at, full = positions[whole][order], keys[whole][order]
        short, of = positions[~whole], keys[~whole]
        grown = Extension(self, at, full) if len(at) else None
        starts = np.concatenate((at, short))
        ends = np.concatenate((at + self.n - 1 + grown.shared if grown else at, short + self.sizes[of]))
        order = np.lexsort((-ends, starts))
        kept = order[ends[order] > np.concatenate(([-1], np.maximum.accumulate(ends[order])[:-1]))]
        windows = np.empty(len(kept), np.int64)
        long = kept < len(at)
        if long.any():
            windows[long] = grown.least(kept[long])
        windows[~long] = self.by_key[self.bounds[of[kept[~long] - len(at)]]]
        return starts[kept], ends[kept], windows


SHARD_WORDS = 1 << 20


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> tuple[str, int]:
    """Writes the benchmark to the shared folder in blocks of about block_chars characters, split by a hash of the item
    and its text: the folder and the number of blocks. Nothing of it reaches the driver."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count, path = max(1, -(-total // block_chars)), fresh_path(benchmark.sparkSession, "benchmark")
    rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count))).repartition("block").write.partitionBy("block").parquet(path)
    return path, count


def _read_block(path: str, block: int) -> list[tuple[str, str]]:
    """A block from the shared folder, in a task; a block without rows has no folder."""
    store, root = fs.FileSystem.from_uri(path)
    files = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/block={block}", allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = [pq.read_table(store.open_input_file(f), columns=["item", "text"]) for f in files]
    return [row for t in tables for row in zip(t["item"].to_pylist(), t["text"].to_pylist(), strict=True)]


SPANS = T.ArrayType(T.StructType([field("start", T.LongType()), field("end", T.LongType())]))
MATCHES = T.ArrayType(T.StructType([field("start", T.LongType()), field("end", T.LongType()), field("item", T.StringType()), field("item_start", T.LongType())]))


def _matched(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_chars: int = 16_000_000, keep: tuple[str, ...] = (), places: bool = False) -> DataFrame:
    """_id, _text, _keep (a struct, so that no name can clash), n_words, hits, items, matches (empty unless places).

    Only one block stands in a worker at a time: of several, all but the last end in a table that the next one reads.
    """
    rest = [docs.schema[c] for c in keep] or [field("none", T.BooleanType())]
    schema = T.StructType([field("_id", id_type(docs, id_col)), field("_text", docs.schema[text_col].dataType), field("_keep", T.StructType(rest)), field("n_words", T.LongType()), field("hits", SPANS), field("items", T.ArrayType(T.StringType())), field("matches", MATCHES)])
    out = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*(F.col(c) for c in keep) if keep else [F.lit(None).cast("boolean").alias("none")]).alias("_keep"),
        F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("hits"), F.array().cast("array<string>").alias("items"), F.array().cast(MATCHES).alias("matches"),
    )
    path, count = _blocks(benchmark, item_col, item_text_col, block_chars)
    before = None
    for block in range(count):
        out = out.mapInArrow(_searcher(path, block, window, schema, places), schema)
        if block < count - 1:
            out = cut(out, "matched")
            if before is not None:
                drop(before)
            before = out
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, text, n_words, hits (array of [start, end) word spans of all windows, merged), items
    (array of distinct item ids as text with an occurring window, sorted) and matches: the longest verbatim matches, as
    word spans [start, end) that lie in no other match, each with the least item, and the least word of it, where the
    same words stand.

    A window is `window` consecutive words of an item, or the whole of a shorter one. Null texts and texts without a
    word have no windows and no hits; a null item id counts as the item ''. Items given twice count once, repeated
    documents each get their row, empty tables give no rows or no hits; other columns are ignored. Texts are searched
    whole.
    """
    found = _matched(docs, benchmark, id_col, text_col, places=True, **options)
    return found.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "n_words", "hits", "items", "matches")


def _searcher(path: str, block: int, window: int, schema: T.StructType, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        tests, arrow = Tests(_read_block(path, block), window), to_arrow_schema(schema)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                numbers, starts, total, first = [], [0], 0, at
                while at < batch.num_rows and total < SHARD_WORDS:
                    words = words_of(batch.column(1)[at].as_py())
                    numbers += [np.fromiter(map(tests.vocabulary.get, words, repeat(0)), np.uint32, len(words)), np.zeros(1, np.uint32)]
                    total += len(words) + 1
                    starts.append(total)
                    at += 1
                yield _marked(batch.slice(first, at - first), tests, np.concatenate(numbers), np.array(starts), arrow, places)

    return run


def _outermost(matches: list[dict]) -> list[dict]:
    """Of the matches of several blocks those that lie in no other one; of equal ones the least place."""
    kept: list[dict] = []
    for m in sorted(matches, key=lambda m: (m["start"], -m["end"], m["item"], m["item_start"])):
        if not kept or m["end"] > kept[-1]["end"]:
            kept.append(m)
    return kept


def _marked(part: pa.RecordBatch, tests: Tests, numbers: np.ndarray, starts: np.ndarray, arrow: pa.Schema, places: bool) -> pa.RecordBatch:
    hits, items, matches = part.column(4).to_pylist(), [set(x) for x in part.column(5).to_pylist()], part.column(6).to_pylist()
    positions, keys = tests.search(numbers)
    deltas = np.bincount(positions, minlength=len(numbers) + 1) - np.bincount(positions + tests.sizes[keys], minlength=len(numbers) + 1)
    of = np.searchsorted(starts, positions, "right") - 1
    for key, d in np.unique(np.stack((keys, of)), axis=1).T:
        items[d].update(tests.items(key))
    for d, spans in enumerate(hits):
        for x in spans:
            deltas[starts[d] + x["start"]] += 1
            deltas[starts[d] + x["end"]] -= 1
    found: list[list[dict]] = [[] for _ in hits]
    for s, e in flags_to_spans(np.cumsum(deltas[:-1]) > 0):
        d = int(np.searchsorted(starts, s, "right")) - 1
        found[d].append({"start": int(s - starts[d]), "end": int(e - starts[d])})
    if places and len(positions):
        more: dict[int, list[dict]] = {}
        for s, e, w in zip(*(x.tolist() for x in tests.longest(positions, keys)), strict=True):
            d = int(np.searchsorted(starts, s, "right")) - 1
            more.setdefault(d, []).append({"start": int(s - starts[d]), "end": int(e - starts[d]), "item": tests.names[tests.item_of[w]], "item_start": int(tests.start_of[w])})
        for d, new in more.items():
            matches[d] = _outermost(matches[d] + new) if matches[d] else new
    n = (np.diff(starts) - 1).astype(np.int64)
    columns = [part.column(0), part.column(1), part.column(2), pa.array(n), *(pa.array(v, arrow.field(c).type) for c, v in (("hits", found), ("items", [sorted(x) for x in items]), ("matches", matches)))]
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def n_hit() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def longest_match() -> Column:
    return F.aggregate("matches", F.lit(0).cast("long"), lambda a, x: F.greatest(a, x["end"] - x["start"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark window."""
    rest = tuple(c for c in docs.columns if c not in (id_col, text_col))
    clean = _matched(docs, benchmark, id_col, text_col, keep=rest, **options).where(F.size("hits") == 0)
    source = {id_col: F.col("_id"), text_col: F.col("_text")}
    return clean.select(*(source.get(c, F.col(f"_keep.{c}")).alias(c) for c in docs.columns))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), longest_match().alias("longest"),
    )


def sha(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


OP8_SQL = r"""
with b as (select distinct coalesce(cast(item_id as varchar), '') item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark where text is not null),
bw as (select distinct item, least(10, len(ws)) m, array_to_string(list_slice(ws, k.i, k.i + least(10, len(ws)) - 1), ' ') g from b, unnest(range(1, greatest(1, len(ws) - 9) + 1)) k(i) where len(ws) > 0),
d as (select row_number() over () rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) ws from documents),
bo as (select b.rn, least(10, len(ws)) m, k.i o, array_to_string(list_slice(ws, k.i, k.i + least(10, len(ws)) - 1), ' ') g from (select *, row_number() over () rn from b) b, unnest(range(1, greatest(1, len(ws) - 9) + 1)) k(i) where len(ws) > 0),
ms as (select distinct m from bw),
dw as (select rid, k.i, ms.m, array_to_string(list_slice(ws, k.i, k.i + ms.m - 1), ' ') g from d, ms, unnest(range(1, len(ws) - ms.m + 2)) k(i)),
h as (select rid, i, m, item from dw join bw using (m, g)),
n as (select rid, count(distinct i + k.j) n_hit from h, unnest(range(0, m)) k(j) group by rid),
s as (select rid, list(distinct item) items from h group by rid),
v as (select rid, m, rn, i - o diag, i - row_number() over (partition by rid, m, rn, i - o order by i) island from dw join bo using (m, g)),
l as (select rid, max(m + c - 1) longest from (select rid, m, count(*) c from v group by rid, m, rn, diag, island) group by rid)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, cast(coalesce(len(items), 0) as bigint) n_items,
  sha256(coalesce(array_to_string(list_sort(items), ','), '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated,
  cast(coalesce(longest, 0) as bigint) longest
from d left join n using (rid) left join s using (rid) left join l using (rid)
"""
