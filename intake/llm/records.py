"""Token ids as length-delimited binary records, with an offset index beside each shard.

A shard is a row of frames: the payload's length (unsigned 64 bits), a masked checksum of those eight bytes, the payload, a masked
checksum of the payload. A checksum is CRC-32 (zlib's), rotated and shifted by a constant so that checksums of data that hold
checksums stay sound. The payload is a flag byte (1: doc_id is there; 2: ids are 32 bits wide, else 16), the doc_id (64 bits), the
ids. All numbers are little-endian. The index of a shard has 32 bytes a record: flag, doc_id, offset of its frame, ids before it in
the shard, number of ids. Tasks write their shards under a name of the attempt and rename them when they are whole, so a repeated
task leaves the same files.

Shards follow each other in ascending doc_id order (nulls first; rows of one doc_id by the hash of their text).

Edge cases: a null text is empty and has the end id alone; an empty table gives no shards; other columns are ignored; a shard
that was changed or cut off raises ValueError when it is read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, stored, text_bytes
from .encode import END, encoder, vocabulary_path

_HEAD = struct.Struct("<QI")
_CHECK = struct.Struct("<I")
_PAYLOAD = struct.Struct("<Bq")
INDEX_TYPE = np.dtype([("flag", "<u4"), ("doc_id", "<i8"), ("offset", "<u8"), ("start", "<u8"), ("n", "<u4")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _CHECK.pack(masked(length)), payload, _CHECK.pack(masked(payload))))


def unframe(stream) -> bytes | None:
    """The next payload of a file, None at its end."""
    head = stream.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError("a record is cut off")
    length, check = _HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length is damaged")
    body = stream.read(length + 4)
    if len(body) < length + 4 or masked(body[:length]) != _CHECK.unpack(body[length:])[0]:
        raise ValueError("a record is damaged")
    return body[:length]


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = ids.dtype.itemsize > 2
    return _PAYLOAD.pack((doc_id is not None) | wide << 1, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flag, doc_id = _PAYLOAD.unpack_from(payload)
    return doc_id if flag & 1 else None, np.frombuffer(payload, "<u4" if flag & 2 else "<u2", offset=_PAYLOAD.size)


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class _Shards:
    """Writes one task's records to files of about `limit` bytes each."""

    def __init__(self, root: str, task: int, attempt: int, limit: int):
        self.fs, self.root = _store(root)
        self.fs.create_dir(self.root, recursive=True)
        self.task, self.attempt, self.limit = task, attempt, limit
        self.out, self.number, self.done = None, 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.out is None:
            self.name = f"shard-{self.task:07d}-{self.number:05d}"
            self.out = self.fs.open_output_stream(f"{self.root}/.{self.name}-{self.attempt}.rec")
            self.entries, self.size, self.n = [], 0, 0
        data = frame(pack(doc_id, ids))
        self.entries.append((doc_id is not None, doc_id or 0, self.size, self.n, len(ids)))
        self.out.write(data)
        self.size += len(data)
        self.n += len(ids)
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        tmp = f"{self.root}/.{self.name}-{self.attempt}"
        with self.fs.open_output_stream(f"{tmp}.idx") as idx:
            idx.write(np.array(self.entries, INDEX_TYPE).tobytes())
        for kind in ("idx", "rec"):
            self.fs.move(f"{tmp}.{kind}", f"{self.root}/{self.name}.{kind}")
        self.done.append((self.name, len(self.entries), self.n))
        self.out, self.number = None, self.number + 1


def write_records(docs: DataFrame, root: str, tokenizer: str | None = None, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encodes every document and writes it under `root` (a URI that all executors reach). Returns shard, n_docs, n_ids."""
    path = tokenizer or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shards, enc = _Shards(root, context.partitionId(), context.taskAttemptId(), shard_bytes), encoder(path)
        end = np.array([END], enc.kind)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                shards.add(doc_id, np.r_[enc.ids(text.as_py()), end])
        shards.close()
        names, n_docs, n_ids = zip(*shards.done) if shards.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n_docs, pa.int64()), pa.array(n_ids, pa.int64())], names=["shard", "n_docs", "n_ids"])

    rows = text_bytes(docs)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(run, "shard string, n_docs long, n_ids long"), "shards")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def placed(shards: DataFrame) -> DataFrame:
    """shard, first: the ids before each shard. One row for each shard of 64 MB."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))


def read_records(shards: DataFrame, root: str) -> DataFrame:
    """All records of the shards: shard, doc_id, start (ids before it in all shards), n_tokens, ids_crc32 (of the ids as 32-bit integers)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = _store(root)
        for pdf in frames:
            for shard, first in zip(pdf["shard"], pdf["first"]):
                rows, start = [], int(first)
                with fs.open_input_stream(f"{folder}/{shard}.rec", buffer_size=1 << 20) as stream:
                    while (payload := unframe(stream)) is not None:
                        doc_id, ids = unpack(payload)
                        rows.append((shard, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                out = pd.DataFrame(rows, columns=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    dealt = placed(shards).repartition(_tasks(shards.sparkSession), "shard")
    return dealt.mapInPandas(run, "shard string, doc_id long, start long, n_tokens long, ids_crc32 long")


def read_index(shards: DataFrame, root: str) -> DataFrame:
    """The offset index: shard, doc_id, offset (of the frame), start (ids before it in its shard), n_tokens."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = _store(root)
        for pdf in frames:
            for shard in pdf["shard"]:
                with fs.open_input_stream(f"{folder}/{shard}.idx") as stream:
                    got = np.frombuffer(stream.read(), INDEX_TYPE)
                ids = pd.array(got["doc_id"].astype("i8"), dtype="Int64")
                ids[got["flag"] == 0] = pd.NA
                yield pd.DataFrame({"shard": shard, "doc_id": ids, "offset": got["offset"].astype("i8"), "start": got["start"].astype("i8"), "n_tokens": got["n"].astype("i8")})

    dealt = shards.select("shard").repartition(_tasks(shards.sparkSession), "shard")
    return dealt.mapInPandas(run, "shard string, doc_id long, offset long, start long, n_tokens long")


def read_shuffled(index: DataFrame, root: str, seed: int = 0, tasks: int | None = None) -> DataFrame:
    """The records that `index` (shard, offset) names, in an order shuffled by `seed`: each task seeks them out. doc_id, ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = _store(root)
        open_files: dict = {}
        for pdf in frames:
            rows = []
            for shard, offset in zip(pdf["shard"], pdf["offset"]):
                if shard not in open_files:
                    if len(open_files) >= 64:
                        open_files.pop(next(iter(open_files))).close()
                    open_files[shard] = fs.open_input_file(f"{folder}/{shard}.rec")
                open_files[shard].seek(int(offset))
                doc_id, ids = unpack(unframe(open_files[shard]))
                rows.append((doc_id, ids.astype("i4")))
            yield pd.DataFrame(rows, columns=["doc_id", "ids"]).astype({"doc_id": "Int64"})

    order = F.xxhash64("shard", "offset", F.lit(seed))
    dealt = index.select("shard", "offset").repartition(tasks or _tasks(index.sparkSession), order).sortWithinPartitions(order)
    return dealt.mapInPandas(run, "doc_id long, ids array<int>")


def read_indexed(index: DataFrame, root: str, block_bytes: int = 8 << 20) -> DataFrame:
    """The records that `index` (shard, doc_id, offset, start, n_tokens) names, each sought out by its entry and compared with it:
    doc_id, start, n_tokens, ids_crc32. Entries that lie within `block_bytes` of a shard are read by one task in the order of their offsets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = _store(root)
        name = stream = None
        for pdf in frames:
            rows = []
            for shard, asked, offset, start, n in zip(pdf["shard"], pdf["doc_id"].astype("Int64"), pdf["offset"], pdf["start"], pdf["n_tokens"]):
                if shard != name:
                    if stream is not None:
                        stream.close()
                    name, stream = shard, fs.open_input_file(f"{folder}/{shard}.rec")
                stream.seek(int(offset))
                doc_id, ids = unpack(unframe(stream))
                if len(ids) != n or (doc_id is None) != (asked is pd.NA) or (doc_id is not None and doc_id != asked):
                    raise ValueError(f"{shard}: the index names another record at {offset}")
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    tasks = _tasks(index.sparkSession)
    dealt = index.repartition(tasks, "shard", F.floor(F.col("offset") / block_bytes)).sortWithinPartitions("shard", "offset")
    return dealt.select("shard", "doc_id", "offset", "start", "n_tokens").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the documents to a new folder in the shared place and reads them back through the offset index: doc_id, start, n_tokens, ids_crc32."""
    root = new_folder(docs.sparkSession, "records")
    shards = write_records(docs, root, tokenizer)
    index = read_index(shards, root).join(F.broadcast(placed(shards)), "shard")  # a row for each shard of 64 MB
    return read_indexed(index.withColumn("start", F.col("first") + F.col("start")), root)
