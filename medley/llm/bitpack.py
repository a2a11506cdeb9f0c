"""Token ids in files of fixed-width bits, with block offsets for random access.

A file holds consecutive documents of one range of ids:

    8 bytes   MAGIC
    5 x u64   bits per id, ids in the file, ids per block, blocks, documents
    u64 each  byte offset of every block, from the start of the packed bits
    i64 each  doc_id of every document (with a u8 each: 1 if it is NULL)
    u64 each  ids before the document in this file, one more entry for the end
    bytes     the blocks: each id in ``bits`` bits, lowest bit first; a block
              starts on a byte

All integers are little-endian.  A file is written under a name of its attempt and
then renamed, so a task that is run again after a lost executor replaces its file
with the same one and readers never see half of it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medley.llm.tokens import END_ID, encoder, vocabulary_file
from medley.session import cut, scratch_path

MAGIC = b"MEDLTOK1"
BLOCK = 4096
FILE_BYTES = 32_000_000  # of packed bits, after which a range goes on in its next file


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, lowest bit first, filled up to a whole byte."""
    spread = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(data: bytes, bits: int, count: int) -> np.ndarray:
    spread = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits).reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = spread
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def dump(documents: list[tuple[int | None, bytes]], bits: int, block: int = BLOCK) -> bytes:
    """A file's bytes from (doc_id, ids as little-endian u32) in order."""
    sizes = np.array([len(data) // 4 for _, data in documents], np.int64)
    ids = np.frombuffer(b"".join(data for _, data in documents), "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id does not fit the vocabulary's width")
    blocks = [pack_ids(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)])[: len(blocks)]
    return b"".join(
        [
            MAGIC,
            struct.pack("<5Q", bits, len(ids), block, len(blocks), len(documents)),
            offsets.astype("<u8").tobytes(),
            np.array([d or 0 for d, _ in documents], "<i8").tobytes(),
            np.array([d is None for d, _ in documents], "u1").tobytes(),
            np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes(),
            *blocks,
        ]
    )


class TokenFile:
    """Reads a file's bytes; ``ids(start, count)`` touches only the blocks that it needs."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.data = memoryview(data)
        self.bits, self.count, self.block, blocks, documents = struct.unpack_from("<5Q", data, 8)
        at = 48
        self.offsets = np.frombuffer(data, "<u8", blocks, at)
        at += 8 * blocks
        self.doc_ids = np.frombuffer(data, "<i8", documents, at)
        at += 8 * documents
        self.null_ids = np.frombuffer(data, "u1", documents, at).astype(bool)
        at += documents
        self.starts = np.frombuffer(data, "<u8", documents + 1, at).astype(np.int64)
        self.base = at + 8 * (documents + 1)

    def block_ids(self, number: int) -> np.ndarray:
        count = min(self.block, self.count - number * self.block)
        at = self.base + int(self.offsets[number])
        return unpack_ids(self.data[at : at + (count * self.bits + 7) // 8], self.bits, count)

    def ids(self, start: int, count: int) -> np.ndarray:
        if not 0 <= start <= start + count <= self.count:
            raise IndexError("outside of the file")
        if not count:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + count - 1) // self.block
        found = np.concatenate([self.block_ids(i) for i in range(first, last + 1)])
        return found[start - first * self.block :][:count]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) in order; each block is unpacked once."""

        @lru_cache(2)
        def block(i: int) -> np.ndarray:
            return self.block_ids(i)

        for doc, null, start, stop in zip(self.doc_ids.tolist(), self.null_ids, self.starts[:-1].tolist(), self.starts[1:].tolist()):
            parts = [block(i) for i in range(start // self.block, -(-stop // self.block))]
            joined = np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, "<u4")
            skip = start - start // self.block * self.block
            yield None if null else doc, start, joined[skip : skip + stop - start]


def _store(folder: str, name: str, data: bytes) -> None:
    place, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    place.create_dir(root, recursive=True)
    attempt = f"{root}/.{name}-{uuid.uuid4().hex}"
    with place.open_output_stream(attempt) as out:
        out.write(data)
    place.move(attempt, f"{root}/{name}")


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, ranges: int | None = None, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Encodes every text, closes it with END_ID and writes the ids in ascending doc_id
    order.  Returns the manifest (file, range, number, documents, ids), already written.

    The ids are split at quantiles of doc_id (from a scan of that column alone), each
    range is sorted and encoded by one task, and a range goes on in its next file after
    ``file_bytes``, so neither memory nor file size depends on how even the ranges are.
    NULL ids come first; rows with the same id are ordered by a hash of their text.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(chosen.agg(F.percentile_approx("doc_id", shares, 100_000)).first()[0] or [])) if shares else []
    limits = F.array(*[F.lit(c) for c in cuts]) if cuts else F.expr("cast(array() as array<bigint>)")
    place = F.coalesce(F.size(F.filter(limits, lambda c: c < F.col("doc_id"))), F.lit(0))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        bits = bits_for(encode.vocabulary)
        held: list[tuple[int | None, bytes]] = []
        here, number, size = None, 0, 0

        def flush():
            name = f"tokens-{here:06d}-{number:06d}.tok"
            _store(folder, name, dump(held, bits))
            return pa.RecordBatch.from_pylist(
                [{"file": name, "range": here, "number": number, "documents": len(held), "ids": sum(len(d) for _, d in held) // 4}],
                schema=manifest,
            )

        for batch in batches:
            for range_, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (range_ != here or size * bits >= file_bytes * 8):
                    yield flush()
                    number, held, size = (number + 1 if range_ == here else 0), [], 0
                here = range_
                held.append((doc_id, encode.encode(text) + end))
                size += len(held[-1][1]) // 4
        if held:
            yield flush()

    manifest = pa.schema([("file", pa.string()), ("range", pa.int64()), ("number", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())])
    return cut(
        chosen.select(place.cast("long").alias("range"), "doc_id", "text")
        .repartition(ranges, "range")
        .sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInArrow(run, "file string, range long, number long, documents long, ids long")
    )


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: ``start`` counts the ids of all documents before."""
    by_range = manifest.groupBy("range").agg(F.sum("ids").alias("ids"))
    outer = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    inner = Window.partitionBy("range").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_range.select("range", F.coalesce(F.sum("ids").over(outer), F.lit(0)).alias("base"))
    files = manifest.join(bases, "range").select(
        "file", (F.col("base") + F.coalesce(F.sum("ids").over(inner), F.lit(0))).alias("first")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                found = list(
                    (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for doc, start, ids in TokenFile(content.as_py()).documents()
                )
                doc, start, count, crc = zip(*found) if found else ((), (), (), ())
                long = pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(doc), pa.string()), *(pa.array(c, long) for c in (doc, start, count, crc))],
                    ["file", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    contents = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.tok")
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
        .mapInArrow(run, "file string, doc_id long, start long, n_tokens long, ids_crc32 long")
    )
    return contents.join(files, "file").select(
        "doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "tokens")
