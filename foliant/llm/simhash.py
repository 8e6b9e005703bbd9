"""Near copies by SimHash: all distinct fingerprints compared, tile against tile.

A fingerprint is the majority of the bits of its text's shingle hashes. Distinct
fingerprints, in the order of their population counts, are dealt into blocks.
Pairs of blocks whose population counts differ by more than the radius are
skipped; so are, within a pair of blocks, pairs of tiles, where a tile holds the
fingerprints with the same population counts in each quarter of 16 bits: if those
four counts differ by more than the radius in sum, so do the fingerprints. What
is left is compared exactly, by exclusive-or and bit counts.

A task that compares two blocks returns no pairs but a spanning forest of them,
so n near copies of each other send n rows and not n².
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import arrow_batches, salted, stored
from foliant.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Distinct fingerprints of a block; pairs compared at once; hashes whose bits are counted at once.
BLOCK, AT_ONCE, HASHES = 1 << 16, 1 << 18, 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text, unsigned: words are split at ASCII blanks, A-Z lower-cased; no word gives 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[shingle - 1 :].tolist() or [len(joined)]
    first = np.r_[0, ends[: len(last) - 1] + 1].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), HASHES):
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(first[at : at + HASHES], last[at : at + HASHES], strict=True)], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, print) for each row of ``docs``: the fingerprint's 64 bits as a long."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["id", "print"])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, print long")


def quarters(prints: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters of each fingerprint, (n, 4)."""
    return np.bitwise_count(prints[:, None] >> np.array([0, 16, 32, 48], np.uint64) & np.uint64(0xFFFF)).astype(np.int16)


def near_forest(one: np.ndarray, two: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (later, earlier) of a spanning forest of the pairs of ``one`` (with itself if ``two`` is None, else with ``two``) that differ in ``radius`` bits at most."""
    sides = [one] if two is None else [one, two]
    ordered, keys, begins = [], [], []
    for x in sides:
        q = quarters(x)
        order = np.lexsort(q.T)
        q = q[order]
        begin = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]).any(1)]) if len(q) else np.zeros(0, np.int64)
        ordered.append(x[order])
        keys.append(q[begin])
        begins.append(np.r_[begin, len(x)])
    a, b, offset = ordered[0], ordered[-1], 0 if two is None else len(ordered[0])
    parent = np.arange(offset + len(b))

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            parent[x] = parent[up]
            x = up

    def join(x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            x, y = roots(x), roots(y)
            apart = x != y
            x, y = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
            np.minimum.at(parent, x, y)

    ends = begins[-1]
    for t in range(len(keys[0])):
        from_tile = t if two is None else 0
        near = np.flatnonzero(np.abs(keys[-1][from_tile:] - keys[0][t]).sum(1) <= radius) + from_tile
        if not len(near):
            continue
        size = ends[near + 1] - ends[near]
        rows = np.repeat(ends[near] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        lo, hi = int(begins[0][t]), int(begins[0][t + 1])
        wide = max(1, min(len(rows), 1 << 12))
        high = max(1, AT_ONCE // wide)
        for p in range(lo, hi, high):
            left = a[p : min(p + high, hi), None]
            for r in range(0, len(rows), wide):
                part = rows[r : r + wide]
                i, j = np.nonzero(np.bitwise_count(left ^ b[part]) <= radius)
                if len(i):
                    join(i + p, part[j] + offset)
    every = a if two is None else np.concatenate([a, b])
    low = roots(np.arange(len(parent)))
    moved = np.flatnonzero(low != np.arange(len(parent)))
    return every[moved], every[low[moved]]


def near_pairs(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the same of the distinct longs ``print`` as all pairs that differ in ``radius`` bits at most."""
    spark = prints.sparkSession
    by_count = dict(prints.groupBy(F.bit_count("print").cast("int")).count().collect())  # 65 rows at most
    blocks, at, room = {}, -1, 0  # population count: its first block, and how many it is dealt to
    for p in sorted(by_count):
        n = by_count[p]
        if n > room or at < 0:
            parts = -(-n // block)
            blocks[p] = (at + 1, parts)
            at, room = at + parts, block - n if parts == 1 else 0
        else:
            blocks[p] = (at, 1)
            room -= n
    if not blocks:
        return spark.createDataFrame([], "a long, b long")
    spans = {}  # of each block, the population counts it may hold
    for p, (first, parts) in blocks.items():
        for k in range(first, first + parts):
            spans[k] = (min(p, spans.get(k, (p, p))[0]), max(p, spans.get(k, (p, p))[1]))
    # blocks are in the order of population counts, so those within reach of one are a range; it is the same for all blocks of a count
    known = []
    for p, (first, parts) in blocks.items():
        low, high = spans[first]
        near = [k for q, (f, m) in blocks.items() for k in (f, f + m - 1) if spans[k][1] >= low - radius and spans[k][0] <= high + radius]
        known.append((p, first, parts, min(near), max(near)))
    table = F.create_map(*[x for p, *v in known for x in (F.lit(p), F.struct(*[F.lit(y).alias(c) for y, c in zip(v, ("first", "parts", "low", "high"), strict=True)]))])
    dealt = prints.select("print", table[F.bit_count("print").cast("int")].alias("of"))
    dealt = dealt.select("print", (F.col("of.first") + F.pmod(F.xxhash64("print"), F.col("of.parts")).cast("int")).alias("mine"), "of.low", "of.high")
    met = dealt.select("print", "mine", F.explode(F.sequence("low", "high")).alias("other")).select("print", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).alias("second"))

    def compare(key, table):
        import pyarrow as pa

        prints, second = table["print"].to_numpy().view(np.uint64), table["second"].to_numpy(zero_copy_only=False)
        a, b = near_forest(prints[~second], None if key[0].as_py() == key[1].as_py() else prints[second], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return met.groupBy("x", "y").applyInArrow(compare, "a long, b long")


def linked(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint, component_id) for each row of ``docs``.

    ``fingerprint`` is 16 lowercase hexadecimal digits. Two rows are linked if
    their fingerprints differ in ``radius`` bits at most; ``component_id`` is the
    least id that links reach. Null and empty texts have the fingerprint zero and
    are linked like others; a text of fewer words than ``shingle`` has one
    shingle. Long texts are read whole. Rows with a null id take part and are
    never the least (null if all that are reached are so); repeated rows get the
    same result each. Other columns are not read; an empty table gives no rows.
    Ids must cast to long.
    """
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "prints")
    least = stored(prints.groupBy("print").agg(F.min("id").alias("least")), "least")
    edges = stored(near_pairs(least.select("print"), radius, block), "near")
    reached = least.join(components(edges).hint("merge"), F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("component", "print").alias("group"))
    reached = stored(reached, "reached")
    firsts = reached.groupBy("group").agg(F.min("least").alias("component_id"))
    found = salted(reached.select("print", "group"), firsts, "group").select("print", "component_id")
    out = salted(prints, found, "print")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
