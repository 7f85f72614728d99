"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds, in this order: one frame for each document (its ids as little-endian unsigned 32-bit
integers), a skippable frame with the documents' ids (signed 64-bit; the smallest value stands for a
missing id), and the seek table of the zstandard seekable format, whose entries have the
compressed size, the size of the content and the low half of the content's XXH64. A reader takes
the two tables from the end and then only the frames it wants.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icetally.llm.shared import Scratch, batched, rows, text_bytes
from icetally.llm.tokens import Encoder

# Fixed values of the zstandard seekable format and of skippable frames.
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
# The skippable frame with the documents' ids.
INDEX_MAGIC = 0x184D2A50

NO_ID = -(2**63)
MANIFEST = "file string, first_id long, n_docs long, n_tokens long, part int"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_file(target, documents: Iterator[tuple[int | None, bytes]], level: int = 3) -> dict:
    """Write frames, index and seek table to a binary stream; returns what the file holds."""
    compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
    ids, entries, n_tokens = [], [], 0
    for doc_id, content in documents:
        frame = compressor.compress(content)
        target.write(frame)
        ids.append(NO_ID if doc_id is None else doc_id)
        check = xxhash.xxh64_intdigest(content) & 0xFFFFFFFF
        entries.append(struct.pack("<III", len(frame), len(content), check))
        n_tokens += len(content) // 4
    index = np.array(ids, "<i8").tobytes()
    target.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
    table = b"".join(entries)
    target.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(table) + 9) + table)
    target.write(struct.pack("<IBI", len(entries), HAS_CHECKSUMS, SEEKABLE_MAGIC))
    return {"first_id": ids[0] if ids else NO_ID, "n_docs": len(ids), "n_tokens": n_tokens}


class SeekableReader:
    """Reads the tables of one file, and then single documents."""

    def __init__(self, source):
        self.source = source
        source.seek(0, io.SEEK_END)
        end = source.tell()
        source.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the file")
        table_at = end - 9 - 12 * n - 8
        index_at = table_at - 8 * n
        source.seek(index_at)
        tables = source.read(8 * n + 8 + 12 * n)
        self.doc_ids = np.frombuffer(tables, "<i8", n)
        entry = np.frombuffer(tables, "<u4", 3 * n, 8 * n + 8).reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(entry[:, 0])))
        self.sizes, self.checks = entry[:, 1], entry[:, 2]
        self.decompressor = zstandard.ZstdDecompressor()

    def document(self, i: int) -> bytes:
        """Content of the i-th frame; raises if its checksum differs."""
        self.source.seek(int(self.starts[i]))
        frame = self.source.read(int(self.starts[i + 1] - self.starts[i]))
        content = self.decompressor.decompress(frame) if self.sizes[i] else b""
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checks[i]:
            raise ValueError(f"document {self.doc_ids[i]} doesn't match its checksum")
        return content


def encode_files(
    docs: DataFrame, folder: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2
) -> DataFrame:
    """Write the documents in ascending ``doc_id`` order, one file for each range of ids.

    Returns the files' manifest (lazy: writing it writes the files). Every attempt of a task
    writes a file of its own name, so a repeated or speculative attempt does no harm: only
    files that the manifest names belong to the output.
    """
    end = np.array([end_id], "<u4").tobytes()
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = text_bytes(docs).repartitionByRange(parts, F.asc_nulls_last("doc_id"))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_last("doc_id"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(vocabulary), TaskContext.get().partitionId()
        filesystem, base = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"

        def contents() -> Iterator[tuple]:
            for doc_id, text in rows(batches, "doc_id", "text"):
                yield doc_id, encoder.encode(text.decode()) + end

        with filesystem.open_output_stream(f"{base}/{name}", compression=None) as target:
            held = write_file(target, contents())
        record = (name, held["first_id"], held["n_docs"], held["n_tokens"], part)
        schema = pa.schema(
            [("file", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()),
             ("n_tokens", pa.int64()), ("part", pa.int32())]
        )
        yield from batched(iter([record]), schema)

    return ordered.mapInArrow(write, MANIFEST)


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """Every document of the files (``file``, ``base``: ids in the files before it): ``doc_id``,
    ``start`` (ids before it), ``n_tokens``, ``ids_crc32``. Checksums are verified."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
         ("ids_crc32", pa.int64())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(folder)

        def records() -> Iterator[tuple]:
            for file, start in rows(batches, "file", "base"):
                with filesystem.open_input_file(f"{base}/{file}") as source:
                    reader = SeekableReader(source)
                    for i, doc_id in enumerate(reader.doc_ids.tolist()):
                        content = reader.document(i)
                        n = len(content) // 4
                        held = None if doc_id == NO_ID else doc_id
                        yield held, start, n, zlib.crc32(content)
                        start += n

        yield from batched(records(), schema)

    return files.select("file", "base").mapInArrow(read, READ)


def read_documents(manifest: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """Ids of the documents named in ``wanted`` (``doc_id``); no other frame is decompressed.

    One row per frame with a wanted id: ``doc_id``, ``ids`` (array of long).
    """
    # A file holds the ids from its first one up to the next file's.
    order = Window.orderBy("part")
    spans = manifest.where("n_docs > 0").select(
        "file", "first_id", F.lead("first_id").over(order).alias("next_id")
    )
    hits = wanted.select("doc_id").where("doc_id is not null").distinct().join(
        spans, F.expr("doc_id >= first_id and (next_id is null or doc_id <= next_id or next_id < first_id)")
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

        def records() -> Iterator[tuple]:
            for file, ids in rows(batches, "file", "ids"):
                with filesystem.open_input_file(f"{base}/{file}") as source:
                    reader = SeekableReader(source)
                    for i in np.flatnonzero(np.isin(reader.doc_ids, ids)):
                        content = np.frombuffer(reader.document(i), "<u4")
                        yield int(reader.doc_ids[i]), content.tolist()

        yield from batched(records(), schema, 200)

    grouped = hits.groupBy("file", F.expr("doc_id div 4096")).agg(F.collect_set("doc_id").alias("ids"))
    return grouped.select("file", "ids").mapInArrow(fetch, "doc_id long, ids array<long>")


def encode_and_read_back(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Write all documents to files in the shared folder and return what reading them gives.

    ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``. Null
    and empty texts are the end id alone; documents without id come last; rows that share an id
    follow each other in any order. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    folder = scratch.path("ids")
    manifest = scratch.write(encode_files(docs, folder, vocabulary), "manifest")
    # One row per file, so one task is enough.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select(
        "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")
    )
    # The number of tasks is stated, so that few bytes of manifest don't become one task.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_files(files.repartition(parts, "file"), folder)


def op10_token_id_output(spark, sf_dir: str) -> DataFrame:
    return encode_and_read_back(spark.read.parquet(f"{sf_dir}/documents.parquet"))
