"""Token-id files: every id in the fewest bits that hold the vocabulary, in blocks with random access.

One shard file holds consecutive documents:

    header   magic "HFTK", version, bits per id, ids per block, ids, documents, footer offset
    blocks   ids packed little-endian, `bits` each; a block starts on an 8-byte word
    footer   block offsets (uint64), document ids (int64) and null marks, document starts (uint64)

`write_tokens` encodes documents in ascending doc_id order (nulls first, equal ids by text) and returns
the manifest: one row per shard with its order, its first id's place among all ids, and its size.
`read_documents` reads the files back. A shard is written under a name of its own by each task attempt
and only counts once the manifest, a Parquet table, names it; lost executors therefore leave at most
files that nobody reads.

Null text is empty (the end id alone is written); repeated rows are written as often as they occur; an
empty table gives no shard; a text of any length is encoded whole in one task and lies in one shard; other
columns are not read.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, encoding

MAGIC = b"HFTK"
HEADER = struct.Struct("<4sHHIQQQ")
BLOCK_IDS = 4096  # a multiple of 64, so that a block is a whole number of 64-bit words
SHARD_IDS = 8 << 20

MANIFEST = "shard_order long, part int, path string, n_ids long, n_docs long"


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Pack ids, padded with zeros to a multiple of 64, into `bits` bits each."""
    lanes = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(lanes), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(raw: bytes, bits: int, count: int) -> np.ndarray:
    words = np.frombuffer(raw, "<u8").reshape(-1, bits)
    lanes = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        lane = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | words[:, word + 1] << np.uint64(64 - shift)
        lanes[:, j] = lane & mask
    return lanes.reshape(-1)[:count].astype(np.uint32)


class ShardWriter:
    """Writes one file; ids are held for at most one block run."""

    def __init__(self, folder: str, bits: int, block_ids: int = BLOCK_IDS):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base)
        self.name = f"{uuid.uuid4().hex}.hftk"
        self.path = f"{folder}/{self.name}"
        self.file_path = f"{base}/{self.name}"
        self.bits, self.block_ids = bits, block_ids
        self.body, self.size, self.held, self.n_held = [], HEADER.size, [], 0
        self.blocks, self.starts, self.docs, self.null, self.n_ids = [], [], [], [], 0

    def _flush(self, last: bool = False) -> None:
        take = self.n_held if last else self.n_held // self.block_ids * self.block_ids
        if not take:
            return
        ids = np.concatenate(self.held)
        self.held, self.n_held = [ids[take:]], len(ids) - take
        for at in range(0, take, self.block_ids):
            raw = pack(ids[at : min(at + self.block_ids, take)], self.bits)
            self.blocks.append(self.size)
            self.body.append(raw)
            self.size += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(0 if doc_id is None else doc_id)
        self.null.append(doc_id is None)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 64 * self.block_ids:
            self._flush()

    def close(self) -> tuple[str, int, int]:
        self._flush(last=True)
        footer = [np.array(self.blocks, "<u8"), np.array(self.docs, "<i8"), np.array(self.null, np.uint8), np.array([*self.starts, self.n_ids], "<u8")]
        with self.fs.open_output_stream(self.file_path) as out:
            out.write(HEADER.pack(MAGIC, 1, self.bits, self.block_ids, self.n_ids, len(self.docs), self.size))
            for raw in self.body:
                out.write(raw)
            for part in footer:
                out.write(part.tobytes())
        return self.path, self.n_ids, len(self.docs)


class ShardReader:
    """Random access to a file: any document, or any range of ids, from the blocks that hold it."""

    def __init__(self, path: str):
        fs, inner = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        magic, version, self.bits, self.block_ids, self.n_ids, self.n_docs, footer = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC or version != 1:
            raise ValueError(f"not a token file: {path}")
        raw = self.file.read_at(self.file.size() - footer, footer)
        n_blocks = -(-self.n_ids // self.block_ids)
        self.blocks = np.frombuffer(raw, "<u8", n_blocks)
        self.docs = np.frombuffer(raw, "<i8", self.n_docs, 8 * n_blocks)
        self.null = np.frombuffer(raw, np.uint8, self.n_docs, 8 * (n_blocks + self.n_docs))
        self.starts = np.frombuffer(raw, "<u8", self.n_docs + 1, 8 * (n_blocks + self.n_docs) + self.n_docs).astype(np.int64)
        self.end = footer

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        to = int(self.blocks[last + 1]) if last + 1 < len(self.blocks) else self.end
        raw = self.file.read_at(to - int(self.blocks[first]), int(self.blocks[first]))
        whole = min((last + 1) * self.block_ids, self.n_ids) - first * self.block_ids
        return unpack(raw, self.bits, whole)[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, run_ids: int = 1 << 20):
        """(doc_id or None, start, ids) of all documents, in order, reading runs of blocks."""
        at = 0
        while at < self.n_docs:
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + run_ids, "right")) - 1)
            base = int(self.starts[at])
            ids = self.ids(base, int(self.starts[to]))
            for k in range(at, to):
                yield None if self.null[k] else int(self.docs[k]), int(self.starts[k]), ids[self.starts[k] - base : self.starts[k + 1] - base]
            at = to


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write docs (doc_id, text) to token files in `folder`; returns the stored manifest.

    One range shuffle of the text puts documents in doc_id order; tokens are never shuffled.
    """
    bits = bits_for(max(encoding.vocabulary_size(tokenizer_path), end_id + 1))

    def write(batches):
        part, n, writer = common.task_partition(), 0, None

        def done(w, k):
            path, n_ids, n_docs = w.close()
            return pa.RecordBatch.from_pydict({"shard_order": [(part << 32) + k], "part": [part], "path": [path], "n_ids": [n_ids], "n_docs": [n_docs]}, schema=pa.schema([("shard_order", pa.int64()), ("part", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

        for batch in batches:
            for piece in common.slices(batch, "text", 2 << 20):
                ids, bounds = encoding.encode(piece.column(1), tokenizer_path, end_id)
                for i, doc_id in enumerate(piece.column(0).to_pylist()):
                    writer = writer or ShardWriter(folder, bits)
                    writer.add(doc_id, ids[bounds[i] : bounds[i + 1]])
                    if writer.n_ids >= shard_ids:
                        yield done(writer, n)
                        writer, n = None, n + 1
        if writer:
            yield done(writer, n)

    order = "doc_id", F.xxhash64("text"), "text"  # rows without or with the same doc_id are dealt by hash; bounds are sampled to the driver, so texts are no part of them
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return common.stage(ordered.mapInArrow(common.tidy(write), MANIFEST), "tokens-manifest")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `base`, the ids in all earlier shards; sums by writer partition first, so that the one
    global running sum is over partitions, not shards."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("part_base"))
    inner = Window.partitionBy("part").orderBy("shard_order")
    return manifest.join(before, "part").withColumn("base", F.col("part_base") + F.sum("n_ids").over(inner) - F.col("n_ids")).drop("part_base")


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of every document, from the files."""

    def read(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                for doc_id, start, ids in ShardReader(path).documents():
                    rows.append((doc_id, base + start, len(ids), ids.astype("<u4").tobytes()))
                    held += len(ids)
                    if held > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    shards = shard_starts(manifest).select("path", "base")
    n = max(1, manifest.count())
    return shards.repartition(min(n, 100_000)).mapInArrow(common.tidy(read), "doc_id long, start long, n_tokens long, ids binary")


def crc32(ids) -> F.Column:
    return F.crc32(ids)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of `documents`, from the written files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_tokens(docs, encoding.public_path("word_bpe_49k.json"), 2, common.new_dir(spark, "token-files"))
    return read_documents(manifest).select("doc_id", "start", "n_tokens", crc32("ids").alias("ids_crc32"))


__all__ = ["write_tokens", "read_documents", "shard_starts", "ShardWriter", "ShardReader", "pack", "unpack", "op3_token_files"]
