"""Packs: lines in gzip blocks, found by hash through a table of places."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of lines after which a block ends.
BLOCK = 64 * 1024


def write_packs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (hash, line) as blocks: pack, block, data (gzip) and held (hash, start, size of each line in the inflated block). A partition is a pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, n, lines, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([n], pa.int64()), pa.array([gzip.compress(b"".join(lines), mtime=0)], pa.binary()), pa.array([held], pa.list_(pa.struct([("hash", pa.string()), ("start", pa.int64()), ("size", pa.int64())])))], names=["pack", "block", "data", "held"])

        for batch in batches:
            for h, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = line.encode()
                held.append({"hash": h, "start": size, "size": len(raw)})
                lines.append(raw + b"\n")
                size += len(raw) + 1
                if size >= block:
                    yield closed()
                    n, lines, held, size = n + 1, [], [], 0
        if lines:
            yield closed()

    return rows.where("hash IS NOT NULL AND line IS NOT NULL").select("hash", "line").mapInArrow(run, "pack long, block long, data binary, held array<struct<hash: string, start: long, size: long>>")


def places(packs: DataFrame) -> DataFrame:
    """hash, pack, block, start, size of each line; blocks are not read."""
    return packs.select("pack", "block", F.explode("held").alias("h")).select("h.hash", "pack", "block", "h.start", "h.size")


def read_packs(packs: DataFrame, wanted: DataFrame) -> DataFrame:
    """hash, line of wanted hashes: only blocks that hold one are inflated, each once."""
    at = places(packs).join(wanted.select("hash").distinct(), "hash", "left_semi")
    lists = at.groupBy("pack", "block").agg(F.collect_list(F.struct("hash", "start", "size")).alias("wanted"))  # at most a block's lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = gzip.decompress(data)
                yield pa.RecordBatch.from_arrays([pa.array([x["hash"] for x in own]), pa.array([raw[x["start"] : x["start"] + x["size"]].decode() for x in own])], names=["hash", "line"])

    return packs.select("pack", "block", "data").join(lists, ["pack", "block"]).select("data", "wanted").mapInArrow(run, "hash string, line string")


def merge_packs(packs: DataFrame, keep: DataFrame, least: float = 0.5, block: int = BLOCK) -> DataFrame:
    """Packs of which less than `least` is still wanted (hash), written together anew; others stay as they are."""
    share = places(packs).join(keep.select("hash").distinct().withColumn("_k", F.lit(1)), "hash", "left").groupBy("pack").agg(F.avg(F.coalesce("_k", F.lit(0))).alias("s"))
    thin = share.where(F.col("s") < least).select("pack")
    again = read_packs(packs.join(thin, "pack", "left_semi"), keep)
    top = packs.agg(F.coalesce(F.max("pack"), F.lit(-1)).alias("_top"))  # one row
    fresh = write_packs(again.dropDuplicates(["hash"]), block).join(F.broadcast(top), F.lit(True)).withColumn("pack", F.col("pack") + F.col("_top") + 1).drop("_top")
    return packs.join(thin, "pack", "left_anti").unionByName(fresh)
