"""Packing of token ids into rows of one length: best fit decreasing, with a segment tree over capacities.

Texts are encoded; one longer than a row is cut into full rows and a rest, so
no id is lost.  Pieces are dealt by a hash of (id, part) to shards of a bounded
number of bytes; each shard is packed by itself: pieces in decreasing length
(then id and part), each into the row with the least room that still holds it,
found by descending a segment tree whose leaves are the rooms 0..capacity.

A packed row has the ids padded to the capacity, cumulative segment lengths
(from 0 to the number of ids) and positions that restart at 0 with each
segment.  ``write`` puts them into files, by shard: the id matrix and the
segment lengths as .npy, the positions, which repeat themselves, as .npz;
``round_trip`` has the packing tasks write these files and reads the rows back.

Defined cases: null and empty texts have no ids and no segment; repeated rows
and ids are packed each by itself, in the order of their parts; a capacity of 1
gives a row an id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import bpe
from quarry.llm._cluster import fresh_dir, release, small_batches, stored
from quarry.llm._text import chunks, lean, ragged, tidy

SHARD_BYTES = 4 << 20


class Rooms:
    """Open rows by the room they have left; the tree tells which rooms occur."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i and not self.tree[i]:
            self.tree[i] = True
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) with the smallest room of at least ``least``; of those the row opened last."""
        i = least + self.size
        while not self.tree[i]:
            while i & 1:  # a right child: its right neighbour is further up
                i >>= 1
                if i <= 1:
                    return None
            if i <= 1:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.tree[i] = False
            i >>= 1
            while i:
                self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]
                if self.tree[i]:
                    break
                i >>= 1
        return room, row


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers; lengths are from 1 to capacity and come in decreasing order."""
    rooms, rows = Rooms(capacity), []
    for piece, n in enumerate(lengths.tolist()):
        found = rooms.take(n)
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(piece)
        if room > n:
            rooms.put(room - n, row)
    return rows


def pieces(docs: DataFrame, ranks: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, ids): each text's ids in parts of at most ``capacity``, as little-endian unsigned integers of 16 bits (of 32 where the vocabulary needs them)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe.merger(ranks)
        width = 2 if len(m.size) <= 1 << 16 else 4
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(1)):
                ids, at = m.encode(data, offs)
                n = np.diff(at)
                parts = -(-n // capacity)
                row = np.repeat(np.arange(hi - lo), parts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = at[row] + part * capacity
                stop = np.minimum(start + capacity, at[row + 1])
                raw = memoryview(ids.astype(f"<u{width}").tobytes())
                rows = [raw[width * x : width * y] for x, y in zip(start.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + row)), pa.array(part.astype(np.int32)), pa.array(rows, pa.binary())], ["id", "part", "ids"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, part int, ids binary")


def pack(docs: DataFrame, ranks: str, capacity: int = 2048, pad: int = 0, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """One packed row each: shard, row, n_tokens, doc_ids, parts, cu_seqlens, ids and positions (binary, ``capacity`` entries of 16 bits, or 32 where they need them, padding included).

    With a folder, cu_seqlens, ids and positions go to files there, as ``write`` has them, and not into the rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    letters = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, -(-letters // SHARD_BYTES))
    cut = pieces(docs, ranks, capacity, id_col, text_col)
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("id", "part"), F.lit(shards)).cast("int"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.append_column("raw", t["ids"]).sort_by([("id", "ascending"), ("part", "ascending"), ("raw", "ascending")]).combine_chunks()
        width = 2 if len(bpe.merger(ranks).size) <= 1 << 16 else 4
        blob = t["ids"].combine_chunks() if isinstance(t["ids"], pa.ChunkedArray) else t["ids"]
        blob = blob.cast(pa.large_binary())
        offs = np.frombuffer(blob.buffers()[1], np.int64, len(blob) + 1, blob.offset * 8) // width
        flat = np.frombuffer(blob.buffers()[2], f"<u{width}")
        n = np.diff(offs)
        order = np.argsort(-n, kind="stable")
        rows = best_fit_decreasing(n[order], capacity)
        members = order[np.array([p for row in rows for p in row], np.int64)]
        at, ends = ragged(offs[members], n[members])
        total = np.array([int(n[order[row]].sum()) for row in rows], np.int64)
        matrix = np.full((len(rows), capacity), pad, f"<u{width}")
        positions = np.zeros((len(rows), capacity), "<u2" if capacity <= 1 << 16 else "<u4")
        inside = np.arange(capacity) < total[:, None]
        matrix[inside] = flat[at]
        positions[inside] = np.arange(len(at)) - np.repeat(ends[:-1], n[members])
        sizes = np.array([len(row) for row in rows])
        lists = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        cu = np.concatenate([np.concatenate([[0], np.cumsum(n[order[row]])]) for row in rows]).astype(np.int32)
        cu_lists = pa.array(np.concatenate([[0], np.cumsum(sizes + 1)]), pa.int32())
        if folder is not None:
            _save(folder, key[0].as_py(), {"ids": matrix, "positions": positions, "cu_seqlens": cu, "cu_offsets": np.concatenate([[0], np.cumsum(sizes + 1)])})
        own = pa.array(members)
        whole = lambda name: (c.combine_chunks() if isinstance(c := t[name], pa.ChunkedArray) else c).take(own)
        out = {
            "shard": pa.array(np.full(len(rows), key[0].as_py(), np.int32)), "row": pa.array(np.arange(len(rows), dtype=np.int32)), "n_tokens": pa.array(total),
            "doc_ids": pa.ListArray.from_arrays(lists, whole("id")), "parts": pa.ListArray.from_arrays(lists, whole("part")),
        }
        if folder is None:
            out |= {
                "cu_seqlens": pa.ListArray.from_arrays(cu_lists, pa.array(cu)),
                "ids": pa.array([x.tobytes() for x in matrix], pa.binary()), "positions": pa.array([x.tobytes() for x in positions], pa.binary()),
            }
        tidy()
        return pa.table(out)

    schema = f"shard int, row int, n_tokens long, doc_ids array<{kind}>, parts array<int>" + ", cu_seqlens array<int>, ids binary, positions binary" * (folder is None)
    return dealt.groupBy("shard").applyInArrow(run, schema)


def digest(packed: DataFrame) -> DataFrame:
    """The packed rows with SHA-256 digests of ids and positions instead of their bytes."""
    return packed.withColumn("ids_sha256", F.sha2("ids", 256)).withColumn("positions_sha256", F.sha2("positions", 256)).drop("ids", "positions")


def _name(kind: str, shard: int) -> str:
    return f"{kind}-{shard:06d}.np{'z' if kind == 'positions' else 'y'}"


def _save(folder: str, shard: int, files: dict[str, np.ndarray]) -> None:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    for kind, value in files.items():
        out = io.BytesIO()
        if kind == "positions":
            raw = io.BytesIO()
            np.save(raw, value)
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                z.writestr("positions.npy", raw.getvalue())
        else:
            np.save(out, value)
        path = f"{root}/{_name(kind, shard)}"
        part = f"{path}.{hashlib.sha256(out.getvalue()).hexdigest()[:8]}.part"
        with fs.open_output_stream(part) as f:
            f.write(out.getvalue())
        fs.move(part, path)


def read(rows: DataFrame, folder: str) -> DataFrame:
    """``rows``, as ``pack`` returns them with a folder, with cu_seqlens, ids_sha256 and positions_sha256 from the shards' files."""
    kept = ["shard", "row", "n_tokens", "doc_ids", "parts"]

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        fs, root = pafs.FileSystem.from_uri(folder)
        t, shard = t.sort_by("row"), key[0].as_py()

        def load(kind: str) -> np.ndarray:
            with fs.open_input_stream(f"{root}/{_name(kind, shard)}") as f:
                found = np.load(io.BytesIO(f.read()))
            return found["positions"] if kind == "positions" else found

        sha = lambda m: pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in m], pa.string())
        cu = pa.ListArray.from_arrays(pa.array(load("cu_offsets"), pa.int32()), pa.array(load("cu_seqlens")))
        out = pa.table([*(t[c] for c in kept), cu, sha(load("ids")), sha(load("positions"))], [*kept, "cu_seqlens", "ids_sha256", "positions_sha256"])
        tidy()
        return out

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept).groupBy("shard").applyInArrow(run, f"{kinds}, cu_seqlens array<int>, ids_sha256 string, positions_sha256 string")


def round_trip(docs: DataFrame, ranks: str, capacity: int = 2048) -> DataFrame:
    """The rows of ``digest``, from files written to the shared folder and read from there."""
    folder = fresh_dir(docs.sparkSession, "packed")
    rows = stored(pack(docs, ranks, capacity, folder=folder), "rows")
    release(docs.sparkSession)
    return read(rows, folder)


def write(packed: DataFrame, folder: str, ranks: str) -> DataFrame:
    """Writes per shard the id matrix, the positions, and the cumulative segment lengths with the rows' offsets in them, as files; returns (shard, rows).

    The files' names come from the shard, and a file appears whole by a rename, so a task may run again.
    """

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        shard, n = key[0].as_py(), t.num_rows
        width = 2 if len(bpe.merger(ranks).size) <= 1 << 16 else 4
        cu = t["cu_seqlens"].to_pylist()
        files = {
            "ids": np.frombuffer(b"".join(t["ids"].to_pylist()), f"<u{width}").reshape(n, -1), "positions": np.frombuffer(b"".join(t["positions"].to_pylist()), "<u2" if len(t["positions"][0].as_py()) * width == 2 * len(t["ids"][0].as_py()) else "<u4").reshape(n, -1),
            "cu_seqlens": np.array([x for row in cu for x in row], np.int32), "cu_offsets": np.cumsum([0, *map(len, cu)]),
        }
        _save(folder, shard, files)
        return pa.table({"shard": pa.array([shard], pa.int32()), "rows": pa.array([n], pa.int64())})

    return packed.groupBy("shard").applyInArrow(run, "shard int, rows long")
