"""Token ids in fixed-width bit-packed blocks.

One row of the file format is a block: the ids of some whole documents, each in
the fewest bits that hold the vocabulary, and where each document starts in it.
Documents lie in ascending ``doc_id`` order over shards, blocks and places. Any
id can be read alone: id ``i`` of a block starts at bit ``i * bits``.

Cases: a null text counts as empty and a document always has its end id; rows
with the same ``doc_id`` are kept side by side; null ids come first; an empty
table gives no blocks; other columns are not read. A document longer than
``block_ids`` has a block of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.arrow import map_batches
from rankloom.llm.tokens import encoder

BLOCKS = (
    "shard int, block int, bits int, shard_start long, n_ids long, doc_ids array<long>, starts array<long>, "
    "payload binary"
)


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits per id, lowest bit first, without gaps."""
    ids = ids.astype("<u4")
    if bits % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    flags = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flags.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` on; nothing before that place is touched."""
    first = start * bits // 8
    raw = np.frombuffer(payload, np.uint8)[first : ((start + count) * bits + 7) // 8]
    if bits % 8 == 0:
        out = np.zeros((count, 4), np.uint8)
        out[:, : bits // 8] = raw.reshape(count, bits // 8)
        return out.view("<u4").ravel()
    flags = np.unpackbits(raw, bitorder="little")[start * bits - first * 8 :][: count * bits]
    full = np.zeros((count, 32), np.uint8)
    full[:, :bits] = flags.reshape(count, bits)
    return np.packbits(full.ravel(), bitorder="little").view("<u4")


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, block_ids: int = 1 << 16) -> None:
    """Encode every text and write the blocks below ``path`` as Parquet, one shard per task."""

    def blocks(batches):
        enc, context = encoder(vocabulary), TaskContext.get()
        shard, bits = context.partitionId() if context else 0, width(max(enc.vocabulary, end_id + 1))
        end = np.array([end_id], "<u4")
        number, written, doc_ids, starts, parts, held = 0, 0, [], [], [], 0

        def row():
            return [[shard], [number], [bits], [written], [held], [doc_ids], [starts], [pack(np.concatenate(parts), bits)]]

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts)):
                if held and held + len(ids) + 1 > block_ids:
                    yield row()
                    number, written, doc_ids, starts, parts, held = number + 1, written + held, [], [], [], 0
                doc_ids.append(doc_id)
                starts.append(held)
                parts += [ids.astype("<u4"), end]
                held += len(ids) + 1
        if held:
            yield row()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_batches(ordered, blocks, BLOCKS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read from the packed blocks.

    ``start``: ids of all documents before it, over all shards; ``n_tokens`` with
    the end id; ``ids_crc32`` of the ids as little-endian 32-bit integers.
    """

    def documents(batches):
        for batch in batches:
            for block in batch.to_pylist():
                places = np.array([*block["starts"], block["n_ids"]])
                ids = [
                    unpack(block["payload"], block["bits"], a, b - a).astype("<u4")
                    for a, b in zip(places[:-1].tolist(), places[1:].tolist())
                ]
                n = len(ids)
                yield [
                    [block["shard"]] * n,
                    block["doc_ids"],
                    (places[:-1] + block["shard_start"]).tolist(),
                    np.diff(places).tolist(),
                    [zlib.crc32(x.tobytes()) for x in ids],
                ]

    files = spark.read.schema(BLOCKS).parquet(path)
    # One row per shard meets in the window: as many as there were tasks.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.alias("before"))
    rows = map_batches(files, documents, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shards, "shard").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
