"""Packing of token ids into rows of one length, by best-fit-decreasing.

Documents are encoded where they are read, cut losslessly into pieces of at
most the row's length, and dealt by hash to shards of about ``shard_chars``
characters. Within a shard the pieces are taken longest first and each goes to
the row with the least room that still holds it; a segment tree over the rooms
0..capacity finds that row. What leaves is a matrix of ids a row at a time, the
cumulative segment lengths, and positions that start anew with each segment.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import arrow_batches
from foliant.llm.pieces import as_bytes, cache, gathered, load, utf8

#: Characters of a shard; shards, not their size, grow with the input.
SHARD_CHARS = 4_000_000


class Rooms:
    """Rows by the room left in them; ``take(n)`` gives a row with the least room of n or more."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.leaves + room
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(room, row), taken out; None if no row has room for n."""
        i, tree = self.leaves + n, self.tree
        while not tree[i]:
            while i & 1:  # up, until a right sibling exists
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.leaves:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            tree[i] -= 1
            i >>= 1
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of positions in ``lengths``, which must be in falling order."""
    rooms, rows = Rooms(capacity), []
    for k, n in enumerate(lengths):
        found = rooms.take(n)
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        rows[found[1]].append(k)
        if found[0] > n:
            rooms.put(found[0] - n, found[1])
    return rows


def pack(docs: DataFrame, capacity: int = 4096, pad_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row per packed row: shard, pack (number in the shard), n_tokens,
    n_segments, doc_ids and piece_nos (of each segment, in order), cu_seqlens
    (0, then the end of each segment), ids and position_ids (binary, little
    endian, ``capacity`` unsigned integers of 2 bytes, of 4 if the vocabulary
    has over 65536 ids; what is beyond n_tokens holds ``pad_id`` and 0).

    Every token of every row of ``docs`` is in exactly one segment. Null and
    empty texts have no tokens and so no segment; long ones are cut into pieces of
    ``capacity`` tokens. Of equally tight rows the earlier is filled, and equally
    long pieces go by id and number. Repeated rows are packed as
    often as they occur. An empty table gives no rows. A document's pieces
    carry its id and their number, so that joining them gives its ids again.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    wide = "<u2" if load(path).size <= 65536 else "<u4"

    def encoded(batches):
        import pyarrow as pa

        words = cache(path, wide, as_bytes(wide))
        for b in batches:
            at, no, ids = [], [], []
            values, place, bounds = words.batch(utf8(b.column(2)))
            flat, ends = gathered(values, place, wide)
            for k, (lo, hi) in enumerate(zip(ends[bounds].tolist(), ends[bounds[1:]].tolist(), strict=False)):
                for p in range(lo, hi, capacity):
                    at.append(k)
                    no.append((p - lo) // capacity)
                    ids.append(flat[p : min(p + capacity, hi)].tobytes())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(no, pa.int32()), pa.array(ids, pa.binary())], ["shard", "id", "piece_no", "ids"])

    def packed(table):
        import pyarrow as pa

        width = int(wide[-1])
        shard = table.column("shard")[0].as_py()
        doc, no, ids = (table.column(x).to_pylist() for x in ("id", "piece_no", "ids"))
        order = sorted(range(len(ids)), key=lambda k: (-len(ids[k]), doc[k] is None, doc[k] if doc[k] is not None else 0, no[k], ids[k]))
        out: dict[str, list] = {x: [] for x in ("shard", "pack", "n_tokens", "n_segments", "doc_ids", "piece_nos", "cu_seqlens", "ids", "position_ids")}
        for pack_no, row in enumerate(best_fit([len(ids[k]) // width for k in order], capacity)):
            parts = [order[k] for k in row]
            lengths = [len(ids[k]) // width for k in parts]
            n = sum(lengths)
            matrix = np.full(capacity, pad_id, wide)
            matrix[:n] = np.frombuffer(b"".join([ids[k] for k in parts]), wide)
            positions = np.zeros(capacity, wide)
            positions[:n] = np.concatenate([np.arange(x) for x in lengths])
            for name, x in (("shard", shard), ("pack", pack_no), ("n_tokens", n), ("n_segments", len(parts)), ("doc_ids", [doc[k] for k in parts]), ("piece_nos", [no[k] for k in parts]), ("cu_seqlens", [0, *np.cumsum(lengths).tolist()]), ("ids", matrix.tobytes()), ("position_ids", positions.tobytes())):
                out[name].append(x)
        kinds = {"shard": pa.int64(), "pack": pa.int32(), "n_tokens": pa.int32(), "n_segments": pa.int32(), "doc_ids": pa.list_(table.schema.field("id").type), "piece_nos": pa.list_(pa.int32()), "cu_seqlens": pa.list_(pa.int32()), "ids": pa.binary(), "position_ids": pa.binary()}
        return pa.table({x: pa.array(v, kinds[x]) for x, v in out.items()})

    shard = F.pmod(F.xxhash64(id_col, text_col), F.lit(shards))
    pieces = docs.select(shard.alias("shard"), F.col(id_col).alias("id"), text_col).mapInArrow(encoded, f"shard long, id {kind}, piece_no int, ids binary")
    return pieces.groupBy("shard").applyInArrow(packed, f"shard long, pack int, n_tokens int, n_segments int, doc_ids array<{kind}>, piece_nos array<int>, cu_seqlens array<int>, ids binary, position_ids binary")


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, in the order of shard and pack within each file, for loaders that read binary columns."""
    packed.sortWithinPartitions("shard", "pack").write.mode("overwrite").parquet(path)
