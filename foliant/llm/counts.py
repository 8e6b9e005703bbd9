"""Token counts by heap-and-linked-list byte-pair merging, without ids.

Each word keeps its symbols in a linked list and its mergeable neighbours in a
heap; the pair of least rank (leftmost of equals) is popped and merged until the
heap is empty. A word's count is its initial symbols minus its merges, where a
character without a piece counts as its UTF-8 bytes.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import arrow_batches
from foliant.llm.pieces import PieceModel, cache, load, utf8


def count_word(word: str, model: PieceModel) -> int:
    """Tokens of one word."""
    pairs, base, unknown = model.pairs, model.size + 1, model.unknown
    sym = model.symbol[[ord(c) for c in word]].tolist()
    n = len(sym)
    count = n
    if unknown in sym:
        count += sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c, s in zip(word, sym, strict=True) if s == unknown)
    heap = []
    for i in range(n - 1):
        found = pairs.get(sym[i] * base + sym[i + 1])
        if found:
            heap.append((found[0], i, sym[i], sym[i + 1], found[1]))
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        _, i, a, b, new = heappop(heap)
        if sym[i] != a:
            continue
        j = after[i]
        if j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = new, -1
        k = after[i] = after[j]
        count -= 1
        if k < n:
            before[k] = i
            found = pairs.get(new * base + sym[k])
            if found:
                heappush(heap, (found[0], i, new, sym[k], found[1]))
        h = before[i]
        if h >= 0:
            found = pairs.get(sym[h] * base + new)
            if found:
                heappush(heap, (found[0], h, sym[h], new, found[1]))
    return count


def as_counts(model: PieceModel):
    """The tokens of each word, for a ``WordCache`` that only splits."""

    def of(words: list[str]) -> list[int]:
        return [count_word(w, model) for w in words]

    return of


def count_tokens(docs: DataFrame, limit: int = 4096, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens; long texts are counted whole.
    Repeated rows stay, an empty table gives none; other columns are not read. Rows are counted where they are read: no shuffle.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        words = cache(path, "counts", as_counts(load(path)), split_only=True)
        for b in batches:
            raws = utf8(b.column(1))
            values, place, bounds = words.batch(raws)
            total = np.r_[0, np.cumsum(np.array(values, np.int64)[place])] if len(place) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raws], pa.int64()), pa.array(np.diff(total[bounds]))], ["id", "n_bytes", "n_tokens"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
