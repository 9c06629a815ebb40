"""What the operators share: reading, Arrow mapping, shared folders, word and hash helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space x20 and x09-x0D, as bytes.split() takes it.
SPACES = " \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session (as in tests) may go without one; it gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='loomstrand-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later steps neither repeat its work nor need its executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark drops shuffle files once the driver has forgotten what made them
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def id_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def crc_mod(column: str, m: int):
    """crc32 of the id as text, modulo m."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def slices(batch: pa.RecordBatch, rows: int, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and, but for single rows, most_bytes bytes."""
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, rows)
        while part.num_rows > 1 and part.nbytes > most_bytes:
            part = part.slice(0, part.num_rows // 2)
        yield part
        at += part.num_rows


def map_rows(df: DataFrame, columns: list[str], schema: T.StructType, each: Callable[..., list[list]], rows: int = 256) -> DataFrame:
    """mapInArrow in slices of few rows and bytes, so that very long texts never stand in Python all at once.

    each(*lists of the columns' values) returns a list of values for each output column.
    """
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        release()
        out = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, rows):
                made = each(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                if len(made[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=out.field(n).type) for n, v in zip(names, made, strict=True)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def hash_sample(df: DataFrame, columns: list[str], rows: int, id_col: str = "doc_id", by: str | None = None, most_groups: int | None = 64) -> list:
    """About `rows` rows of df (of each value of `by`), never over four times as many, as [*columns, by] on the driver.

    A row is taken if a hash of its id is small enough for the number of rows there are, so that each task sends only
    its share of the sample, however many tasks there are. At most the `most_groups` commonest values of `by` count, or all if it is None.
    """
    h = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 40))
    if by is None:
        total = df.count()
        return df.where(h < int((1 << 40) * min(1.0, rows / max(1, total)))).select(*columns).limit(4 * rows).collect()
    counts = df.where(F.col(by).isNotNull()).groupBy(by).count().orderBy(F.desc("count"), by)
    counts = (counts if most_groups is None else counts.limit(most_groups)).collect()
    bound = lambda n: int((1 << 40) * min(1.0, rows / n))
    rule = F.lit(False)
    if most_groups is None and counts:  # one flat expression, however many values there are
        kind = df.schema[by].dataType
        rule = h < F.element_at(F.create_map(*(x for value, n in counts for x in (F.lit(value).cast(kind), F.lit(bound(n)).cast("long")))), F.col(by))
    elif counts:
        for value, n in counts:
            rule = rule | ((F.col(by) == value) & (h < bound(n)))
    return df.where(rule).select(*columns, by).limit(4 * rows * max(1, len(counts))).collect()


#: What empties the caches that workers keep from task to task; modules add theirs.
KEPT: list[Callable[[], None]] = []


def release() -> None:
    """Gives back what earlier stages left in this worker: Spark uses its workers again, with all they remember."""
    for clear in KEPT:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def give_back(spark: SparkSession) -> None:
    """Executors return what earlier stages took: a task for each core collects the garbage of its JVM, whose heap then
    shrinks, and empties its worker. A heap that has once been full otherwise stays so for all stages that follow."""
    cores = spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from batches

    spark.range(0, cores, 1, cores).select("id", F.expr("reflect('java.lang.System', 'gc')").alias("gc")).mapInArrow(run, "id long, gc string").count()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finisher)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, base, np.uint64))
        down = np.cumprod(np.full(n, inverse, np.uint64))
    return up, down


KEPT.append(_powers.cache_clear)


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=1)
def _is_word_byte() -> np.ndarray:
    found = np.ones(256, bool)
    found[[32, 9, 10, 11, 12, 13]] = False
    return found


BASE = 0x9E3779B97F4A7C15 | 1


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first bytes) of the words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes, in order; equal words have equal 64-bit
    hashes anywhere. A polynomial of random byte codes modulo 2**64 from one running sum, then mixed with the length.
    """
    raw = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], _is_word_byte()[raw], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    up, down = _powers(1 << max(16, len(raw).bit_length()), BASE)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_byte_codes()[raw] * up[: len(raw)], out=total[1:])
        found = (total[end] - total[start]) * down[start]
        found += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(found), start


def batch_words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' words, bounds): the words of text k are hashes[bounds[k]:bounds[k + 1]]."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join(data)
    hashes, start = word_hashes(joined.translate(LOWER) if lower else joined)
    at = np.concatenate(([0], np.cumsum([len(d) + 1 for d in data])))
    return hashes, np.searchsorted(start, at)


def flags_to_spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """The [start, end) runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def window_hashes(words: np.ndarray, n: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """A 64-bit hash of each window of n word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:count].copy()
        for j in range(1, n):
            out *= np.uint64(base)
            out += words[j : j + count]
    return mix(out)
