"""Token ids in files of length-delimited binary records.

A record is framed as: length of the data (8 bytes), masked checksum of the length (4), data, masked checksum of the data
(4), all little-endian. The data are a byte for the kind of id (0 integer, 1 null, 2 text), the id, a byte for the width
of a token and the tokens. Beside each file stands an index of the records' offsets (8 bytes each), for shuffled reads.

Each task writes one file of a range of ids, under a name of its own first, and moves it into place when it is whole; a
task that runs again leaves the same bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstrand.llm.common import field, fresh_path, id_type, slices, table
from loomstrand.llm.tokens import encoder, tokenizer_path


def masked(data: bytes) -> int:
    """A checksum that is safe to store next to data which hold checksums: rotated and moved by a constant."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked(length)), data, struct.pack("<I", masked(data))))


def unframe(buffer: bytes, at: int = 0) -> tuple[bytes, int]:
    """The data of the record that begins at `at`, and where the next begins; ValueError if a checksum fails."""
    length = buffer[at : at + 8]
    if len(length) < 8 or struct.unpack_from("<I", buffer, at + 8)[0] != masked(length):
        raise ValueError(f"damaged length at byte {at}")
    end = at + 12 + struct.unpack("<Q", length)[0]
    data = buffer[at + 12 : end]
    if len(buffer) < end + 4 or struct.unpack_from("<I", buffer, end)[0] != masked(data):
        raise ValueError(f"damaged data at byte {at}")
    return data, end + 4


def serialize(key, ids: bytes) -> bytes:
    """ids: little-endian unsigned 32-bit. Stored in 16 bits each where all fit."""
    if key is None:
        head = b"\x01"
    elif isinstance(key, int):
        head = b"\x00" + struct.pack("<q", key)
    else:
        text = str(key).encode()
        head = b"\x02" + struct.pack("<I", len(text)) + text
    tokens = np.frombuffer(ids, "<u4")
    narrow = not len(tokens) or int(tokens.max()) < 1 << 16
    return b"".join((head, b"\x02" if narrow else b"\x04", tokens.astype("<u2").tobytes() if narrow else ids))


def deserialize(data: bytes) -> tuple[int | str | None, np.ndarray]:
    kind, at = data[0], 1
    key = None
    if kind == 0:
        key, at = struct.unpack_from("<q", data, 1)[0], 9
    elif kind == 2:
        n = struct.unpack_from("<I", data, 1)[0]
        key, at = data[5 : 5 + n].decode(), 5 + n
    return key, np.frombuffer(data, f"<u{data[at]}", offset=at + 1).astype("<u4")


def open_path(uri: str):
    """(file system, path) of a URI: local or shared folders, and stores that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes all rows in ascending order of id (null first) and returns the manifest: one entry for each file, in order,
    with path, records and tokens (the tokens of all records).

    Null and empty texts are records of the end id alone. Rows of one id stand together, ordered by a hash and the text;
    a hot id may be dealt to several files. An empty table gives no file.
    """
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    rows = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    schema = T.StructType([field("part", T.LongType()), field("path", T.StringType()), field("records", T.LongType()), field("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        files, base = open_path(folder)
        files.create_dir(base, recursive=True)
        name, own = f"{base}/part-{part:07d}", f"{base}/.{part:07d}-{uuid.uuid4().hex}"
        offsets, tokens, at, out = [], 0, 0, None
        encode = encoder(tokenizer).encode
        for batch in batches:
            for piece in slices(batch, 4096):
                out = out or files.open_output_stream(own)
                for key, ids in zip(piece.column(0).to_pylist(), encode(piece.column(1)), strict=True):
                    record = frame(serialize(key, ids + end))
                    out.write(record)
                    offsets.append(at)
                    at += len(record)
                    tokens += len(ids) // 4 + 1
        if out:
            out.close()
            with files.open_output_stream(f"{own}.index") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            files.move(f"{own}.index", f"{name}.index")
            files.move(own, f"{name}.records")
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{part:07d}"], "records": [len(offsets)], "tokens": [tokens]})

    found = rows.mapInArrow(run, schema).collect()
    return [{"path": r["path"], "records": r["records"], "tokens": r["tokens"]} for r in sorted(found, key=lambda r: r["part"])]


def read_record(path: str, k: int) -> tuple[int | str | None, np.ndarray]:
    """Record k of a file alone, by its index."""
    files, base = open_path(path)
    with files.open_input_file(f"{base}.index") as index:
        at = struct.unpack("<Q", index.read_at(8, 8 * k))[0]
    with files.open_input_file(f"{base}.records") as data:
        length = struct.unpack("<Q", data.read_at(8, at))[0]
        return deserialize(unframe(data.read_at(length + 16, at))[0])


def read_records(spark: SparkSession, manifest: list[dict], key_type: T.DataType, with_ids: bool = False) -> DataFrame:
    """One row for each record: id, start (the tokens of all records before it), n_tokens, ids_crc32 (of the tokens as
    little-endian unsigned 32-bit integers), and ids if wanted. Every checksum is tested; one task reads each file."""
    starts = np.concatenate(([0], np.cumsum([m["tokens"] for m in manifest]))).tolist()
    paths = [m["path"] for m in manifest]
    schema = T.StructType([field("id", key_type), *(field(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")), *([field("ids", T.ArrayType(T.LongType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                start = starts[k]
                files, base = open_path(paths[k])
                rows: list[list] = [[] for _ in schema.names]
                with files.open_input_stream(f"{base}.records") as data:
                    while head := data.read(12):
                        size = struct.unpack("<Q", head[:8])[0] if len(head) == 12 and struct.unpack("<I", head[8:])[0] == masked(head[:8]) else None
                        if size is None:
                            raise ValueError(f"damaged length in {paths[k]}")
                        key, ids = deserialize(unframe(head + data.read(size + 4))[0])
                        values = [key, start, len(ids), zlib.crc32(ids.tobytes()), *([ids.tolist()] if with_ids else [])]
                        for column, v in zip(rows, values, strict=True):
                            column.append(v)
                        start += len(ids)
                        if len(rows[0]) == 1024:
                            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, arrow, strict=True)], schema=arrow)
                            rows = [[] for _ in schema.names]
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, arrow, strict=True)], schema=arrow)

    n = len(manifest)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, schema)


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = write_records(docs, fresh_path(spark, "token-records"), tokenizer_path("word_bpe_49k.json"), 1)
    return read_records(spark, manifest, id_type(docs, "doc_id")).withColumnRenamed("id", "doc_id")
