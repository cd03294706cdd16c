"""Sorted record files, byte for byte: gzip blocks of lines, blocks of key entries, a footer and a trailer.

A file's id is the SHA-256 of its content in canonical JSON, which holds entries and not compressed bytes; so equal rows
give equal ids whatever compresses them. mark is the name that a store's format carries in its footer.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import jcs, removal_line

# Fixed values of the format.
BLOCK_BYTES = 262_144
KEY_BLOCK = 1024
MOST_ENTRIES = 1_048_576
VERSION = 3
TRAILER = bytes([0x55, 0x4C, 0x33, 0x53, 0x52, 0x46, 0x0A, 0x00])


@dataclass(frozen=True)
class Row:
    """kind r (line given), x (removal) or w (withheld: hash and size given)."""

    kind: str
    type: str
    id: str
    line: str | None = None
    commit: int | None = None
    hash: str | None = None
    size: int | None = None


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def build(rows: Iterable[Row], labeled: bool, mark: str) -> tuple[str, dict, bytes]:
    """Id, content and bytes of the file of rows in key order (and commit order, if labeled). Rows that were rewritten unchanged share a line."""
    blocks: list[bytes] = []
    entries: list[list] = []
    held = bytearray()
    total = lines = 0
    last: tuple | None = None

    for r in rows:
        order = (r.type.encode(), r.id.encode(), r.commit or 0)
        if last and order <= last[0]:
            raise ValueError("rows are not in order")
        if r.kind == "w":
            entry = ["w", r.type, r.id, r.hash, r.size, None, None]
        else:
            raw = (r.line if r.kind == "r" else removal_line(r.id, r.type)).encode()
            digest = _sha(raw) if r.kind == "r" else None
            same = labeled and last and last[1] and entries[-1][:4] == [r.kind, r.type, r.id, digest]
            if same:
                entry = entries[-1][:7]
            else:
                if len(held) >= BLOCK_BYTES:
                    blocks.append(bytes(held))
                    held = bytearray()
                entry = [r.kind, r.type, r.id, digest, len(raw), len(blocks), len(held)]
                held += raw + b"\n"
                total += len(raw) + 1
                lines += 1
        entries.append(entry + [r.commit] * labeled)
        last = (order, r.kind != "w")
        if len(entries) > MOST_ENTRIES:
            raise ValueError("too many entries for a file")
    if held:
        blocks.append(bytes(held))

    keys = [b"".join(jcs(e).encode() + b"\n" for e in entries[a : a + KEY_BLOCK]) for a in range(0, len(entries), KEY_BLOCK)]
    kinds = [e[0] for e in entries]
    content = {
        mark: VERSION, "labeled": labeled, "entries": len(entries), "lines": lines, "records": kinds.count("r"), "removals": kinds.count("x"), "withheld": kinds.count("w"), "bytes": total,
        "first": entries[0][1:3] if entries else None, "last": entries[-1][1:3] if entries else None,
        "commits": [min(e[7] for e in entries), max(e[7] for e in entries)] if labeled and entries else None,
        "keyBlocks": [[*entries[n * KEY_BLOCK][1:3], _sha(k), k.count(b"\n")] for n, k in enumerate(keys)],
    }
    packed = [[gzip.compress(b, mtime=0) for b in part] for part in (blocks, keys)]
    footer = gzip.compress(jcs({"content": content, "locator": {"recordBlocks": [len(b) for b in packed[0]], "keyBlocks": [len(b) for b in packed[1]]}}).encode(), mtime=0)
    data = b"".join([*packed[0], *packed[1], footer, TRAILER, len(footer).to_bytes(8, "big")])
    return _sha(jcs(content).encode()), content, data


class File:
    """A file that is read from its end: footer, key blocks whose range may hold a key, then record blocks."""

    def __init__(self, data: bytes):
        if len(data) < 16 or data[-16:-8] != TRAILER:
            raise ValueError("not a sorted record file")
        end = len(data) - 16
        footer = json.loads(gzip.decompress(data[end - int.from_bytes(data[-8:], "big") : end]))
        self.data, self.content = data, footer["content"]
        self.id = _sha(jcs(self.content).encode())
        sizes, at = footer["locator"], 0
        self.spans: dict[str, list[tuple[int, int]]] = {}
        for part in ("recordBlocks", "keyBlocks"):
            self.spans[part] = []
            for n in sizes[part]:
                self.spans[part].append((at, at + n))
                at += n

    def _block(self, part: str, n: int) -> bytes:
        a, b = self.spans[part][n]
        return zlib.decompress(self.data[a:b], 31)

    def covers(self, type_: str, id_: str) -> bool:
        key = (type_.encode(), id_.encode())
        first, last = (self.content[x] and tuple(s.encode() for s in self.content[x]) for x in ("first", "last"))
        return first is not None and first <= key <= last

    def entries(self) -> Iterator[list]:
        for n in range(len(self.spans["keyBlocks"])):
            yield from map(json.loads, self._block("keyBlocks", n).splitlines())

    def line(self, entry: list) -> str | None:
        if entry[0] == "w":
            return None
        return self._block("recordBlocks", entry[5])[entry[6] : entry[6] + entry[4]].decode()

    def find(self, type_: str, id_: str) -> list[list]:
        """Entries of a key, from the key blocks that can hold it only."""
        key = (type_.encode(), id_.encode())
        starts = [(t.encode(), i.encode()) for t, i, _, _ in self.content["keyBlocks"]]
        out = []
        for n, start in enumerate(starts):
            if start <= key and (n + 1 == len(starts) or key <= starts[n + 1]):
                out += [e for e in map(json.loads, self._block("keyBlocks", n).splitlines()) if (e[1], e[2]) == (type_, id_)]
        return out

    def problems(self) -> list[str]:
        """What does not hold: hashes of key blocks and lines, order, counts."""
        out, last, counts = [], None, {"r": 0, "x": 0, "w": 0}
        for n, (_, _, digest, _) in enumerate(self.content["keyBlocks"]):
            if _sha(self._block("keyBlocks", n)) != digest:
                out.append(f"key block {n}")
        for e in self.entries():
            key = (e[1].encode(), e[2].encode(), e[7] if len(e) > 7 else 0)
            if last is not None and key <= last:
                out.append(f"order of {e[1]} {e[2]}")
            last = key
            counts[e[0]] += 1
            line = self.line(e)
            if line is not None and (len(line.encode()) != e[4] or (e[0] == "r" and _sha(line.encode()) != e[3])):
                out.append(f"line of {e[1]} {e[2]}")
        if [counts[k] for k in "rxw"] != [self.content[k] for k in ("records", "removals", "withheld")]:
            out.append("counts")
        return out


def write_files(rows: DataFrame, by: str, mark: str, labeled: bool = False) -> DataFrame:
    """rows (by, kind, type, id, line; for labeled files also commit, and hash and size of withheld ones) as files, one for each value of by, which holds MOST_ENTRIES rows at most: by, file_id, entries, data. layouts.files_cut gives values of by that are bounded."""
    names = ["kind", "type", "id", "line", *(["commit", "hash", "size"] * labeled)]

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        cells = (group[c].astype(object).where(group[c].notna(), None) for c in names)
        made = [Row(*r) for r in zip(*cells, strict=True)]
        made = [Row(r.kind, r.type, r.id, r.line, None if r.commit is None else int(r.commit), r.hash, None if r.size is None else int(r.size)) for r in made]
        id_, content, data = build(sorted(made, key=lambda r: (r.type.encode(), r.id.encode(), r.commit or 0)), labeled, mark)
        return pd.DataFrame([(key[0], id_, content["entries"], data)], columns=[by, "file_id", "entries", "data"])

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(F.col(by), *names).groupBy(by).applyInPandas(one, f"{by} {kind}, file_id string, entries long, data binary")


def lookup(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries (file_id, type, id, kind, hash, line) of keys (type, id) in files (file_id, data, first, last: structs of type and id): files that cannot hold a key are not opened, and of others the key blocks that may."""
    t, i = F.col("k.type"), F.col("k.id")
    inside = (F.struct(t, i) >= F.struct("f.first.type", "f.first.id")) & (F.struct(t, i) <= F.struct("f.last.type", "f.last.id"))
    dealt = files.alias("f").join(F.broadcast(keys.alias("k")), inside).groupBy("f.file_id").agg(F.first("f.data").alias("data"), F.collect_set(F.struct(t.alias("type"), i.alias("id"))).alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, data, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = File(data)
                out += [(name, e[1], e[2], e[0], e[3], f.line(e)) for k in own if f.covers(k["type"], k["id"]) for e in f.find(k["type"], k["id"])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["file_id", "type", "id", "kind", "hash", "line"])

    return dealt.mapInArrow(run, "file_id string, type string, id string, kind string, hash string, line string")


def scan_files(files: DataFrame) -> DataFrame:
    """Every entry (file_id, type, id, kind, hash, commit) of files (file_id, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 5 + [pa.int64()]
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = [(name, e[1], e[2], e[0], e[3], e[7] if len(e) > 7 else None) for e in File(data).entries()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["file_id", "type", "id", "kind", "hash", "commit"])

    return files.select("file_id", "data").mapInArrow(run, "file_id string, type string, id string, kind string, hash string, commit long")


def file_problems(files: DataFrame) -> DataFrame:
    """What does not hold of files (file_id, data): file_id, problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    f = File(data)
                    out += [(name, p) for p in f.problems()] + [(name, "id")] * (f.id != name)
                except (ValueError, OSError, EOFError, zlib.error, KeyError) as e:
                    out.append((name, type(e).__name__))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["file_id", "problem"])

    return files.select("file_id", "data").mapInArrow(run, "file_id string, problem string")
