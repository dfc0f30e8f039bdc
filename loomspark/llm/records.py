"""Operator 1: token ids as length-delimited binary records.

A shard is a run of frames; a frame is
    length   u64   bytes of the payload
    check    u32   masked crc32 of the eight length bytes
    payload        one byte (lowest bit 1: the id isn't null; the rest: bytes of a token id, 2 or 4), the i64 document
                   id, the token ids as unsigned integers of that width
    check    u32   masked crc32 of the payload
all little-endian. The mask turns the checksum by 15 bits and adds a constant, so that checksums of data that hold
checksums stay meaningful. Beside each shard lies an index: u64 offsets of the frames, then the shard's length, so
that record k of a shard is found without reading the others (read_at).

Shards follow doc_id: shard order, then frame order, is ascending doc_id (nulls first; equal ids by their place in the input).
Nulls: a null text is the empty text. Every text ends with end_id. An empty table makes no shards. Any other columns
of the input are left aside. A task that runs again writes its shard anew under the same name by a rename.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.batches import groups, small_batches, texts_of
from loomspark.llm.tokenize import encoder
from loomspark.sources.workspace import fresh_path

HEAD, HEAD_BYTES = "<QI", 12
KEY, KEY_BYTES = "<Bq", 9
MASK_ADD = 0xA282EAD8
SHARDS = "shard int, path string, records long, tokens long, bytes long"
READ = "shard int, doc_id long, start long, n_tokens long, "


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def frames(stream) -> Iterator[bytes]:
    """Payloads of a shard, read in order; a broken length, checksum or end raises ValueError."""
    while head := stream.read(HEAD_BYTES):
        if len(head) != HEAD_BYTES or masked(head[:8]) != struct.unpack(HEAD, head)[1]:
            raise ValueError("broken record head")
        n = struct.unpack(HEAD, head)[0]
        payload, check = stream.read(n), stream.read(4)
        if len(payload) != n or len(check) != 4 or struct.unpack("<I", check)[0] != masked(payload):
            raise ValueError("broken record")
        yield payload


def as_u32(payload: bytes) -> bytes:
    """A payload's ids as little-endian unsigned 32-bit integers."""
    import numpy as np

    return np.frombuffer(payload, f"<u{payload[0] >> 1}", offset=KEY_BYTES).astype("<u4").tobytes()


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(documents: DataFrame, encode: Callable[[], Callable[[list[str]], list[bytes]]], path: str, shards: int, end_id: int, width: int = 4) -> DataFrame:
    """Write the shards under path; one row for each: shard, path, records, tokens, bytes.

    encode() makes texts -> ids as u32 bytes; width is 2 for vocabularies of at most 65536 ids.
    """
    import numpy as np
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    from loomspark.llm.batches import schema_of

    spark = documents.sparkSession
    arrow, end = to_arrow_schema(schema_of(SHARDS)), struct.pack("<I", end_id)
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, f = task.partitionId(), encode()
        store, base = _store(path)
        store.create_dir(base, recursive=True)
        name, own = f"{base}/part-{shard:06d}", f"{base}/.part-{shard:06d}.{task.attemptNumber()}.{task.taskAttemptId()}"
        at, tokens, offsets = 0, 0, []
        with store.open_output_stream(own) as out:
            for ids, texts in groups(batches, 1):
                for key, got in zip(ids, f(texts), strict=True):
                    data = frame(struct.pack(KEY, (key is not None) + 2 * width, key or 0) + np.frombuffer(got + end, "<u4").astype(kind).tobytes())
                    out.write(data)
                    offsets.append(at)
                    at += len(data)
                    tokens += len(got) // 4 + 1
        if not offsets:
            store.delete_file(own)
            return
        with store.open_output_stream(f"{own}.index") as out:
            out.write(struct.pack(f"<{len(offsets) + 1}Q", *offsets, at))
        store.move(f"{own}.index", f"{name}.index")
        store.move(own, f"{name}.records")
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard, f"part-{shard:06d}", len(offsets), tokens, at), arrow.types, strict=True)], schema=arrow)

    # rows that share a doc_id, or have none, are told apart by their place, so that they need not fall into one shard
    dealt = texts_of(documents).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(max(1, shards), "doc_id", "place")
    dealt = dealt.sortWithinPartitions("doc_id", "place").drop("place")
    made = sorted(small_batches(dealt).mapInArrow(run, schema_of(SHARDS)).collect())  # one row a shard
    return spark.createDataFrame(made, SHARDS)


def read_records(spark: SparkSession, path: str, manifest: DataFrame, value: Callable[[bytes], object] = bytes, kind: str = "ids binary") -> DataFrame:
    """The records of the shards: shard, doc_id, start (token ids in all records before), n_tokens, and a value of the ids as u32 bytes: by default these.

    The manifest has a row a shard, so its running sum is made on the driver. Each shard is read as a stream.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from loomspark.llm.batches import schema_of

    rows, total = [], 0
    for r in sorted(manifest.collect()):
        rows.append((r["shard"], r["path"], total))
        total += r["tokens"]
    arrow = to_arrow_schema(schema_of(READ + kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, base = _store(path)
                with store.open_input_stream(f"{base}/{name}.records", buffer_size=1 << 20) as stream:
                    held, size = [], 0
                    for payload in frames(stream):
                        has, key = struct.unpack_from(KEY, payload)
                        ids = as_u32(payload)
                        n = len(ids) // 4
                        held.append((shard, key if has & 1 else None, start, n, value(ids)))
                        start, size = start + n, size + len(ids)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)

    listed = spark.createDataFrame(rows, "shard int, name string, start long").repartition(max(1, len(rows)), "shard")
    return listed.mapInArrow(run, schema_of(READ + kind))


def read_at(path: str, name: str, numbers: list[int]) -> list[tuple[int | None, bytes]]:
    """Records of one shard by their numbers, in the order asked for, by way of the index: (doc_id, ids)."""
    import io

    store, base = _store(path)
    out = []
    with store.open_input_file(f"{base}/{name}.index") as index, store.open_input_file(f"{base}/{name}.records") as records:
        for k in numbers:
            index.seek(8 * k)
            lo, hi = struct.unpack("<QQ", index.read(16))
            records.seek(lo)
            payload = next(frames(io.BytesIO(records.read(hi - lo))))
            has, key = struct.unpack_from(KEY, payload)
            out.append((key if has & 1 else None, as_u32(payload)))
    return out


def shard_count(documents: DataFrame, mb: int = 16) -> int:
    """Shards of about mb MB of input each, by the plan's estimate of its size; the session's shuffle partitions at least."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(size // (mb * 1_000_000), 1_000_000))


def digest(spark: SparkSession, documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """The query's columns, from files written and read back."""
    path = fresh_path(spark, "records")
    manifest = write_records(documents, lambda: encoder(tokenizer, "word").encode, path, shard_count(documents), end_id, width=2)
    return read_records(spark, path, manifest, zlib.crc32, "ids_crc32 long").drop("shard")
