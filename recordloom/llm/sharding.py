"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 .. n-1 in the order of (doc_id, text fingerprint, size), so the numbering does not depend on files or
partitions. permute() is a bijection of 0 .. n-1; position p lies in shard p mod k at slot p div k, so shards' counts are
at most one apart, slots have no gaps, and shard and slot of a row number (and back) need no table.

Only ids, sizes and checksums are sorted; texts stay where they are. Defined results: a null text has no bytes; null
ids sort first; rows that repeat are numbered each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fingerprint, table, tuned
from .textscan import mix

SHARDS = 24
KEYS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)
_U = np.uint64


def _width(n: int) -> int:
    """Bits of a half, so that both halves number at least n."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(x: np.ndarray, key: int, bits: int) -> np.ndarray:
    return mix(x + _U(key)) & _U((1 << bits) - 1)


def _feistel(x: np.ndarray, bits: int, keys: tuple[int, ...], back: bool) -> np.ndarray:
    left, right = x >> _U(bits), x & _U((1 << bits) - 1)
    for key in reversed(keys) if back else keys:
        left, right = (right ^ _round(left, key, bits), left) if back else (right, left ^ _round(right, key, bits))
    return left << _U(bits) | right


def permute(x: np.ndarray, n: int, keys: tuple[int, ...] = KEYS, back: bool = False) -> np.ndarray:
    """Row numbers to positions, or back; a value outside 0 .. n-1 walks on along its cycle."""
    bits, x = _width(n), np.array(x, _U)
    x = _feistel(x, bits, keys, back)
    while len(out := np.flatnonzero(x >= _U(n))):
        x[out] = _feistel(x[out], bits, keys, back)
    return x.astype(np.int64)


def locate(number: np.ndarray, n: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers."""
    p = permute(number, n)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS) -> np.ndarray:
    """Row number at a shard's slot."""
    return permute(np.asarray(slot) * shards + shard, n, back=True)


def numbered(rows: DataFrame, order: list[str], name: str = "numbered") -> tuple[DataFrame, int]:
    """rows with a gapless long `number` in the given order, and their count. Rows that tie in order should be alike."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = F.monotonically_increasing_id()
    ranged = rows.withColumn("_tie", tie).repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    kept = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row per partition
    before, total = {}, 0
    for r in sizes:
        before[r["part"]] = total
        total += r["n"]
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "_part long, _before long")
    out = kept.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row per partition
    return out.withColumn("number", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before"), total


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, number, shard, slot."""
    tuned(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), fingerprint().alias("fp"))
    rows, n = numbered(slim, ["doc_id", "fp.a", "fp.b", "size"])
    rows = rows.select("doc_id", "size", "text_crc32", "number")
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, slot = locate(np.asarray(batch.column(3)), n, shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(slot)], names=schema.names)

    return rows.mapInArrow(place, schema)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _times(x: str, c: int) -> str:
    """x times a constant modulo 2^64, in halves that fit 128 bits."""
    return f"((({x}) * {c >> 32} % 4294967296) * 4294967296 + ({x}) * {c & 0xFFFFFFFF}) % 18446744073709551616"


_KEY_LIST = "[" + ", ".join(f"CAST({k} AS HUGEINT)" for k in KEYS) + "]"
#: Numbers in the order of ids, which are unique in the given table, rounds of the permutation one at a time until a value is in range, and CRC-32 by its table.
OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) - 1 AS k, doc_id, coalesce(text, '') AS text FROM documents),
z AS (SELECT count(*) AS n, CAST(power(2, greatest(1, (CAST(ceil(log2(greatest(count(*), 2))) AS BIGINT) + 1) // 2)) AS HUGEINT) AS b FROM d),
w(k, t, l, r) AS (
  SELECT k, 0, CAST(k AS HUGEINT) // b, CAST(k AS HUGEINT) % b FROM d, z
  UNION ALL
  SELECT k, t + 1, r, xor(l, xor(a4, a4 // 2147483648) % b) FROM (
    SELECT *, {_times("a3", 0x94D049BB133111EB)} AS a4 FROM (
      SELECT *, xor(a2, a2 // 134217728) AS a3 FROM (
        SELECT *, {_times("a1", 0xBF58476D1CE4E5B9)} AS a2 FROM (
          SELECT *, xor(a0, a0 // 1073741824) AS a1 FROM (SELECT w.*, b, (r + {_KEY_LIST}[t % {len(KEYS)} + 1]) % 18446744073709551616 AS a0 FROM w, z WHERE NOT (t > 0 AND t % {len(KEYS)} = 0 AND l * b + r < n))))))),
p AS (SELECT k, CAST(l * b + r AS BIGINT) AS p FROM w, z WHERE t > 0 AND t % {len(KEYS)} = 0 AND l * b + r < n),
c0 AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) AS q(i)),
ct(i, c, step) AS (SELECT i, c, step FROM c0 UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM ct WHERE step < 8),
tt AS (SELECT list(c ORDER BY i) AS tab FROM ct WHERE step = 8),
h AS (SELECT k, doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS m FROM d),
y AS (SELECT k, doc_id, m, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substring(x, 2 * j + 1, 2) AS BIGINT) FOR j IN range(0, m)]), lambda s, u: xor(s // 256, tab[xor(s % 256, u) + 1])) AS crc FROM h, tt)
SELECT doc_id, CAST(m + 8 AS BIGINT) AS size, xor(crc, 4294967295) AS text_crc32, 'rows' AS law, CAST(p % {SHARDS} AS INTEGER) AS shard, p // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM y JOIN p ON p.k = y.k
"""
