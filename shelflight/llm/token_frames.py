"""Token ids in shards of independent zstandard frames with a trailing seek table.

A shard holds, in ascending document order:

- one zstandard frame for each document: its ids as little-endian unsigned
  32-bit integers, with content size and content checksum;
- a skippable frame (document table): a zstandard frame of the documents' ids
  as little-endian signed 64-bit integers, then a byte for each that is 1 where
  the id is null;
- a skippable frame in the public seekable zstandard format (seek table): for
  each frame its compressed size, its size and the low 32 bits of the XXH64 of
  its content, then the number of frames, a descriptor byte and the magic number.

So a reader fetches the tail of a shard, and then only the frames of the
documents asked for. Shards are written by Spark tasks, each to a name of its
own attempt and then renamed, so a task that runs again leaves one whole file.
The manifest lists the shards with their numbers of documents and ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.llm.chunk_table import ChunkTable, chunks_by_line, cuts_at_marks

SKIPPABLE_DOCS = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
LEVEL = 3


#: Settings of Hadoop's S3 connector that its files are opened with here too.
_S3 = {
    "fs.s3a.access.key": "access_key",
    "fs.s3a.secret.key": "secret_key",
    "fs.s3a.session.token": "session_token",
    "fs.s3a.endpoint": "endpoint_override",
    "fs.s3a.endpoint.region": "region",
}


def store_settings(spark: SparkSession) -> dict[str, str]:
    """What the session's Hadoop settings say of stores that Python opens itself; read on the driver and sent to the tasks."""
    conf = spark._jsc.hadoopConfiguration()
    names = (*_S3, "fs.s3a.connection.ssl.enabled", "fs.s3a.path.style.access")
    return {n: v for n in names if (v := conf.get(n))}


def s3_options(settings: dict[str, str]) -> dict[str, object]:
    options: dict[str, object] = {own: settings[n] for n, own in _S3.items() if n in settings}
    plain = settings.get("fs.s3a.connection.ssl.enabled") == "false"
    if "endpoint_override" in options:
        scheme, _, host = str(options["endpoint_override"]).rpartition("://")
        options["endpoint_override"] = host.rstrip("/")
        plain = scheme == "http" or (plain and scheme != "https")
        # without an endpoint of its own the store's names are hosts anyway
        options["force_virtual_addressing"] = settings.get("fs.s3a.path.style.access") != "true"
    return options | {"scheme": "http" if plain else "https"}


def filesystem(path: str, settings: dict[str, str] | None = None) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, and the path in it.

    s3a and s3n are Hadoop's names of S3: they are opened with the session's keys and
    endpoint (``store_settings``), and with what the environment grants where it
    names none. hdfs and viewfs need Hadoop's native client library on every machine.
    """
    scheme = path.partition(":")[0].lower()
    if scheme in ("s3", "s3a", "s3n"):
        return pafs.S3FileSystem(**s3_options(settings or {})), path.partition("://")[2]
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class ShardWriter:
    """Writes one shard; ``add`` in document order, then ``close``."""

    def __init__(self, stream):
        self.stream = stream
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        content = ids.astype("<u4").tobytes()
        frame = self.compressor.compress(content)
        self.stream.write(frame)
        self.frames.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.doc_ids.append(doc_id)

    def close(self) -> None:
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        docs = np.array([d or 0 for d in self.doc_ids], "<i8")
        table = self.compressor.compress(docs.tobytes() + null.tobytes())
        self.stream.write(struct.pack("<II", SKIPPABLE_DOCS, len(table)) + table)
        seek = np.array(self.frames, "<u4").reshape(-1, 3).tobytes()
        footer = struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek) + len(footer)) + seek + footer)


class ShardReader:
    """Random access to one shard through a seekable file."""

    def __init__(self, file):
        self.file = file
        self.decompressor = zstandard.ZstdDecompressor()
        size = file.size()
        count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError("not a shard: its seek table is missing")
        at = size - 9 - 12 * count
        self.frames = np.frombuffer(file.read_at(12 * count, at), "<u4").reshape(-1, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.frames[:, 0], dtype=np.int64)))
        docs = file.read_at(at - 8 - int(self.starts[-1]), int(self.starts[-1]))
        kind, length = struct.unpack("<II", docs[:8])
        if kind != SKIPPABLE_DOCS:
            raise ValueError("not a shard: its document table is missing")
        table = self.decompressor.decompress(docs[8 : 8 + length])
        null = np.frombuffer(table[8 * count :], np.uint8)
        self.doc_ids = [None if n else int(d) for d, n in zip(np.frombuffer(table[: 8 * count], "<i8"), null)]

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document; raises ValueError where the checksum differs."""
        size, length, checksum = map(int, self.frames[k])
        content = self.decompressor.decompress(self.file.read_at(size, int(self.starts[k])), max_output_size=length)
        if len(content) != length or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(content, "<u4")

    def find(self, wanted: Iterable[int | None]) -> Iterator[tuple[int | None, np.ndarray]]:
        """The documents of the given ids; decompresses no other frame."""
        wanted = set(wanted)
        for k, doc_id in enumerate(self.doc_ids):
            if doc_id in wanted:
                yield doc_id, self.ids(k)


@lru_cache(2)
def _table(tokenizer: str) -> ChunkTable:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark task, one core
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)
    size = own.get_vocab_size()
    # byte-level pieces write the space as U+0120
    begins = np.array([(own.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
    return ChunkTable(
        lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)],
        begins,
        chunks_by_line,
        max_chunks=800_000,
        max_ids=6_000_000,
        finer=cuts_at_marks([t.content for t in own.get_added_tokens_decoder().values()]),
    )


def write_tokens(
    df: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> list[dict]:
    """Encode each whole text, append ``end_id``, and write shards and a manifest below ``path``.

    ``tokenizer`` is a tokenizers file with byte-level pieces cut before single
    spaces. Null texts count as empty: one id, the end. Documents lie in
    ascending order of ``doc_id`` over all shards, null ids first; rows that
    repeat an id all stay, in the order of their texts' hashes. Other columns are
    ignored. An empty table gives a manifest without documents. The path is new.
    Returns the manifest: a row for each shard, as many as Spark has partitions.
    """
    if not re.match(r"\w+:", path):
        path = f"file://{os.path.abspath(path)}"
    rows = df.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    ).withColumns({"hash": F.xxhash64("text"), "turn": F.monotonically_increasing_id()})
    # rows that repeat exactly still differ in their turn, so that they need not fall into one shard
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("turn")]
    settings = store_settings(df.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        store, at = filesystem(path, settings)
        name = f"{at}/shard-{shard:06d}.tokens"
        own = f"{at}/_attempt-{shard:06d}-{context.taskAttemptId()}"
        table, docs, total = _table(tokenizer), 0, 0
        store.create_dir(at, recursive=True)
        with store.open_output_stream(own) as stream:
            writer = ShardWriter(stream)
            for batch in batches:
                keys, at_row = batch.column(0).to_pylist(), 0
                for count, ids, ends in table.encode_column(batch.column(1), most_chars=1 << 23):
                    begin = 0
                    for key, end in zip(keys[at_row : at_row + count], ends.tolist()):
                        writer.add(key, np.append(ids[begin:end], end_id))
                        docs, total, begin = docs + 1, total + end - begin + 1, end
                    at_row += count
            writer.close()
        store.move(own, name)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [docs], "tokens": [total]})

    written = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(write, "shard long, docs long, tokens long")
    )
    manifest, start = [], 0
    for row in sorted(written.collect()):  # a row for each partition
        manifest.append({"shard": row.shard, "docs": row.docs, "tokens": row.tokens, "start": start})
        start += row.tokens
    store, at = filesystem(path, settings)
    store.create_dir(at, recursive=True)  # an empty table has no tasks
    with store.open_output_stream(f"{at}/manifest.json") as stream:
        stream.write(json.dumps(manifest).encode())
    return manifest


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document, from the shards below ``path``.

    start counts the ids of all documents before it. Ids are longs, being
    unsigned 32-bit numbers. Every frame's checksum is tested.
    """
    return _read(spark, path, "doc_id long, start long, ids array<long>", lambda ids: pa.array(ids, pa.list_(pa.int64())))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards below ``path``."""
    return _read(
        spark,
        path,
        "doc_id long, start long, n_tokens long, ids_crc32 long",
        lambda ids: pa.array([len(x) for x in ids], pa.int64()),
        lambda ids: pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
    )


def _read(spark: SparkSession, path: str, schema: str, *columns) -> DataFrame:
    if not re.match(r"\w+:", path):
        path = f"file://{os.path.abspath(path)}"
    settings = store_settings(spark)
    store, at = filesystem(path, settings)
    with store.open_input_file(f"{at}/manifest.json") as file:
        manifest = [m for m in json.loads(file.read()) if m["docs"]]
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = filesystem(path, settings)
                with store.open_input_file(f"{at}/shard-{shard:06d}.tokens") as file:
                    reader = ShardReader(file)
                    starts = start + np.concatenate(([0], np.cumsum(reader.frames[:, 1].astype(np.int64) // 4)))
                    for first in range(0, len(reader.doc_ids), 256):
                        ids = [reader.ids(k) for k in range(first, min(first + 256, len(reader.doc_ids)))]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.doc_ids[first : first + 256], pa.int64()),
                                pa.array(starts[first : first + len(ids)]),
                                *[make(ids) for make in columns],
                            ],
                            names=names,
                        )

    shards = spark.createDataFrame([(m["shard"], m["start"]) for m in manifest], "shard long, start long")
    return shards.repartition(max(1, len(manifest)), "shard").mapInArrow(read, schema)
