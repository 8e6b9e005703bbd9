"""Removal of repeated byte strings with a Burrows-Wheeler transform.

Every string of ``length`` bytes contains an anchor: of its substrings of
``ANCHOR`` bytes the one with the least hash. Neighbouring strings with the same
anchor form a fragment, and equal strings have equal anchors, so repeats can be
judged anchor by anchor, wherever they are:

1. where documents are read they are cut into fragments, of which a digest and
   the place go on; repeats within a batch are settled there, so a frequent
   passage sends one row for each batch;
2. equal fragments are settled by their digests: all but the first go;
3. fragments that share an anchor but differ are gathered, many anchors to a
   bucket, and their suffixes sorted; from the transform, breadth-first backward
   extension of intervals gives the common prefixes of neighbouring suffixes by
   increasing value, up to ``length``. What is then unset is a repeat.

An anchor with more than ``hot`` different fragments has its strings dealt out
one by one, by digest, instead: exact as well, and no task holds them together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import arrow_batches, stored
from foliant.llm.jaccard import _powers, mix

LENGTH, ANCHOR, HOT = 100, 40, 20_000
#: Characters of the input for each bucket of digests, and of fragments for each bucket of suffixes.
BUCKET_CHARS, SORT_BYTES = 16_000_000, 1_000_000
#: Bytes of text that are hashed at once.
CHUNK_BYTES = 1 << 20

_BYTES = [mix(np.arange(1, 257, dtype=np.uint64), s) for s in (11, 13)]
_LAST = np.iinfo(np.int64).max


def _sums(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any substring follows."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * _powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start], 1)


def fragments(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, anchor: int):
    """(document, first string, last string, anchor's hash, digest) of each fragment of the documents raw[start:end], in order."""
    none = np.zeros(0, np.int64)
    if not (ends - starts >= length).any():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    width, n = length - anchor + 1, len(raw)
    sums, other = (_sums(raw, t) for t in _BYTES)
    at = np.arange(n - anchor + 1)
    h = _hash(sums, at, at + anchor)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # the leftmost of equals
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    where = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # by first byte of a string
    long = np.flatnonzero(ends - starts >= length)
    count = ends[long] - starts[long] - length + 1
    doc = np.repeat(long, count)
    first = np.repeat(starts[long] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    m = where[first]
    new = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[new[1:], len(first)] - 1
    a, b = first[new], first[last]
    return doc[new], a, b, h[m[new]], _hash(other, a, b + length) ^ (m[new] - a).astype(np.uint64)


def _in_chunks(raw: list[bytes], starts: np.ndarray, length: int, anchor: int):
    """``fragments`` of documents, by chunks of bounded size; places count into the concatenation of all.

    A long document is cut into pieces that overlap by less than a string, so every
    string is in one piece; its anchor is the same there.
    """
    pieces = [(k, p, x[p : p + CHUNK_BYTES + length - 1]) for k, x in enumerate(raw) for p in range(0, max(len(x) - length + 1, 0), CHUNK_BYTES)]
    out, lo = [], 0
    while lo < len(pieces):
        hi, size = lo, 0
        while hi < len(pieces) and (hi == lo or size + len(pieces[hi][2]) <= CHUNK_BYTES):
            size += len(pieces[hi][2])
            hi += 1
        ends = np.cumsum([len(x) for _, _, x in pieces[lo:hi]], dtype=np.int64)
        begins = np.r_[0, ends[:-1]]
        piece, first, last, h, digest = fragments(np.frombuffer(b"".join([x for _, _, x in pieces[lo:hi]]), np.uint8), begins, ends, length, anchor)
        doc, at = (np.array([x[k] for x in pieces[lo:hi]], np.int64) for k in (0, 1))
        move = (starts[doc] + at - begins)[piece]
        out.append((doc[piece], first + move, last + move, h, digest))
        lo = hi
    if not out:
        return fragments(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), length, anchor)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` symbols at least, by doubling."""
    _, rank = np.unique(symbols, return_inverse=True)
    n, k = len(symbols), 1
    while True:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
        k *= 2
        if k >= depth or k >= n or rank[order[-1]] == n - 1:
            return order


def repeats(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, the offsets at which a string of ``length`` bytes begins that also begins earlier, in an earlier part or before in this one.

    The parts are concatenated, each with an end mark of its own. For intervals
    of suffixes that begin with a string w, level by level, those that begin
    with cw are found through the transform; the first to end at a boundary
    gives the common prefix there, and only it is extended further.
    """
    marks = len(parts)
    text = np.concatenate([np.r_[np.frombuffer(p, np.uint8).astype(np.int64) + marks, i] for i, p in enumerate(parts)])
    n = len(text)
    order = suffix_array(text, length)
    before = text[order - 1]
    before[order == 0] = -1
    before[(before >= 0) & (before < marks)] = -1
    to = np.empty(n, np.int64)  # from a suffix to the one a symbol longer
    to[np.argsort(before, kind="stable")] = np.arange(n)
    skip = int((before < 0).sum())
    sizes = np.bincount(np.maximum(text - marks + 1, 0), minlength=257)
    to += marks - skip  # suffixes that begin with a mark come first
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    low = np.r_[np.arange(marks), marks + np.r_[0, np.cumsum(sizes[1:])[:-1]]]
    high = np.r_[np.arange(1, marks + 1), marks + np.cumsum(sizes[1:])]
    go = (high > low) & unset[high]
    low, high = low[go], high[go]
    unset[high] = False
    for _ in range(1, length):
        if not len(low):
            break
        size = high - low
        pos = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        c = before[pos]
        key = np.repeat(np.arange(len(low)), size) * 512 + (c - marks)
        real = c >= 0
        key, pos = key[real], pos[real]
        if not len(key):
            break
        by = np.argsort(key, kind="stable")
        key, place = key[by], to[pos[by]]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        low, high = place[first], place[np.r_[first[1:], len(key)] - 1] + 1
        go = unset[high]
        low, high = low[go], high[go]
        unset[high] = False
    run = np.cumsum(~unset[:n]) - 1  # suffixes of a run share ``length`` bytes or more
    firsts = np.full(int(run[-1]) + 1, n)
    np.minimum.at(firsts, run, order)
    late = np.sort(order[order != firsts[run]])
    ends = np.cumsum([len(p) + 1 for p in parts])
    cut = np.searchsorted(late, ends)
    return [late[a:b] - (e - len(p) - 1) for a, b, e, p in zip(np.r_[0, cut[:-1]], cut, ends, parts, strict=True)]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted intervals, those that touch or overlap made one."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[new], reach[np.r_[new[1:], len(start)] - 1]


def spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, gone): texts (id, mark, text, kept) of ``docs``, with ``keep`` in a struct; gone (id, mark, start, n), byte spans that are repeated.

    ``mark`` is a hash of the text. Documents are ordered by id (null last), those
    of one id by mark; rows that are equal in both are one document.
    """
    if not 1 <= anchor <= length <= CHUNK_BYTES:
        raise ValueError(f"1 <= anchor <= length <= {CHUNK_BYTES} must hold: {anchor}, {length}")
    spark = docs.sparkSession
    arrow_batches(spark)
    known = [F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text_col).alias("mark"), F.coalesce(text_col, F.lit("")).alias("text")]
    texts = docs.select(*known)
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    buckets = max(1, -(-chars // BUCKET_CHARS))
    place = "id long, mark long, start long, n int"

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            ids, marks = (b.column(k).to_numpy() for k in (0, 1))
            order = np.lexsort((marks, ids))
            order = order[np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(marks[order]) != 0)]] if len(order) else order
            ids, marks = ids[order], marks[order]
            texts = b.column(2).take(pa.array(order)).cast(pa.binary())
            raw = texts.to_pylist()
            ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
            starts = np.r_[0, ends[:-1]] if len(ends) else ends
            doc, first, last, h, digest = _in_chunks(raw, starts, length, anchor)
            by = np.lexsort((digest, h))
            again = np.zeros(len(by), bool)
            again[by[1:]] = (h[by[1:]] == h[by[:-1]]) & (digest[by[1:]] == digest[by[:-1]])
            out = {k: [] for k in ("bucket", "id", "mark", "start", "n", "frags")}
            if again.any():
                a, e = _merged(first[again], last[again] + length)
                # a span may run over the end of a document into the next only where both are repeated
                d = np.searchsorted(ends, a, "right")
                for x, y, k in zip(a.tolist(), e.tolist(), d.tolist(), strict=True):
                    while x < y:
                        stop = min(y, int(ends[k]))
                        if stop > x:
                            for name, v in zip(out, (None, int(ids[k]), int(marks[k]), x - int(starts[k]), stop - x, None), strict=True):
                                out[name].append(v)
                        x, k = stop, k + 1
            keep = np.flatnonzero(~again)
            bucket = (mix(h[keep], 17) % np.uint64(buckets)).astype(np.int64)
            keep, bucket = keep[np.argsort(bucket, kind="stable")], np.sort(bucket)
            for rows in np.split(np.arange(len(keep)), np.flatnonzero(np.diff(bucket)) + 1) if len(keep) else []:
                f = keep[rows]
                used, ref = np.unique(doc[f], return_inverse=True)
                blob = b"".join([np.array([len(f), len(used)], "<u4").tobytes(), h[f].tobytes(), digest[f].tobytes(), ids[used].tobytes(), marks[used].tobytes(), ref.astype("<u4").tobytes(), (first[f] - starts[doc[f]]).astype("<u4").tobytes(), (last[f] - first[f]).astype("<u4").tobytes()])
                for name, v in zip(out, (int(bucket[rows[0]]), None, None, None, None, blob), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("frags", pa.binary())]))

    def settle(table):
        import pyarrow as pa

        h, digest, ids, marks, start, more = ([] for _ in range(6))
        for blob in table["frags"].to_pylist():
            n, d = np.frombuffer(blob, "<u4", 2)
            at, got = 8, []
            for kind, k in (("<u8", n), ("<u8", n), ("<i8", d), ("<i8", d), ("<u4", n), ("<u4", n), ("<u4", n)):
                got.append(np.frombuffer(blob, kind, k, at))
                at += int(k) * int(kind[-1])
            for to, v in zip((h, digest, ids, marks, start, more), (got[0], got[1], got[2][got[4]], got[3][got[4]], got[5], got[6]), strict=True):
                to.append(v)
        h, digest, ids, marks, start, more = (np.concatenate(x) for x in (h, digest, ids, marks, start, more))
        order = np.lexsort((start, marks, ids, digest, h))
        same = np.all([x[order[1:]] == x[order[:-1]] for x in (h, digest, ids, marks, start)], axis=0)
        order = order[np.r_[True, ~same]]  # repeated rows of a document, from different batches
        h, digest, ids, marks, start, more = (x[order] for x in (h, digest, ids, marks, start, more))
        anew = np.r_[True, h[1:] != h[:-1]]
        dnew = anew | np.r_[True, digest[1:] != digest[:-1]]
        group = np.cumsum(anew) - 1
        different = np.bincount(group[dnew])[group]
        keep = ~dnew | (different > 1)
        kind = np.where(~dnew, 0, np.where(different > hot, 2, 1))
        return pa.table({"anchor": h[keep].view(np.int64), "id": ids[keep], "mark": marks[keep], "start": start[keep].astype(np.int64), "n": (more[keep].astype(np.int64) + length).astype(np.int32), "kind": kind[keep].astype(np.int32)})

    cuts = stored(texts.mapInArrow(cut, "bucket long, id long, mark long, start long, n int, frags binary"), "fragments")
    settled = stored(cuts.filter("bucket IS NOT NULL").select("bucket", "frags").groupBy("bucket").applyInArrow(settle, f"anchor long, {place}, kind int"), "settled")
    gone = cuts.filter("bucket IS NULL").select("id", "mark", "start", "n").unionByName(settled.filter("kind = 0").select("id", "mark", "start", "n"))

    counts = settled.filter("kind > 0").agg(F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("n"))), F.lit(0)), F.count_if(F.col("kind") == 2)).first()
    if counts[0] or counts[1]:
        wanted = settled.filter("kind > 0").groupBy("id", "mark").agg(F.collect_list(F.struct("anchor", "start", "n", "kind")).alias("wanted"))
        held = wanted.join(texts.hint("merge"), ["id", "mark"])

        def take(batches):
            import pyarrow as pa

            for b in batches:
                out, seen = {k: [] for k in ("anchor", "id", "mark", "start", "bytes", "kind")}, set()
                for i, m, w, t in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                    if (i, m) in seen:
                        continue
                    seen.add((i, m))
                    raw = t.encode("utf-8", "surrogatepass")
                    for x in w:
                        for name, v in zip(out, (x["anchor"], i, m, x["start"], raw[x["start"] : x["start"] + x["n"]], x["kind"]), strict=True):
                            out[name].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary()), ("kind", pa.int32())]))

        parts = stored(held.select("id", "mark", "wanted", "text").mapInArrow(take, "anchor long, id long, mark long, start long, bytes binary, kind int"), "parts")

        def sort(table):
            import pyarrow as pa

            anchor, ids, marks, start = (table[k].to_numpy() for k in ("anchor", "id", "mark", "start"))
            order = np.lexsort((start, marks, ids))
            # repeated rows of a document, from different batches
            order = order[np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(marks[order]) != 0) | (np.diff(start[order]) != 0)]]
            raw = table["bytes"].take(pa.array(order)).to_pylist()
            out = [[], [], [], []]
            for k, late in zip(order.tolist(), repeats(raw, length), strict=True):
                if len(late):
                    a, e = _merged(late, late + length)
                    for v, x in zip(out, (np.full(len(a), ids[k]), np.full(len(a), marks[k]), a + start[k], e - a), strict=True):
                        v.append(x)
            join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            return pa.table({"id": join(out[0], np.int64), "mark": join(out[1], np.int64), "start": join(out[2], np.int64), "n": join(out[3], np.int32)})

        sorts = max(1, -(-int(counts[0]) // SORT_BYTES))
        by_anchor = F.pmod(F.xxhash64("anchor"), F.lit(sorts)).alias("unit")
        gone = gone.unionByName(parts.filter("kind = 1").select(by_anchor, "anchor", "id", "mark", "start", "bytes").groupBy("unit").applyInArrow(sort, place))
        if counts[1]:

            def each(batches):
                import pyarrow as pa

                for b in batches:
                    ids, marks, start = (b.column(k).to_numpy() for k in range(3))
                    raw = b.column(3).to_pylist()
                    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
                    flat = np.frombuffer(b"".join(raw), np.uint8)
                    count = np.array([len(x) - length + 1 for x in raw], np.int64)
                    at = np.repeat(ends - [len(x) for x in raw] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                    row = np.repeat(np.arange(len(raw)), count)
                    one, two = (_hash(_sums(flat, t), at, at + length).view(np.int64) for t in _BYTES)
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(ids[row]), pa.array(marks[row]), pa.array(start[row] + at - (ends[row] - np.array([len(x) for x in raw])[row]))], ["one", "two", "id", "mark", "start"])

            strings = parts.filter("kind = 2").select("id", "mark", "start", "bytes").mapInArrow(each, "one long, two long, id long, mark long, start long")
            strings = stored(strings, "strings")
            firsts = strings.groupBy("one", "two").agg(F.min(F.struct("id", "mark", "start")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
            late = strings.join(firsts.hint("merge"), ["one", "two"]).filter(F.struct("id", "mark", "start") != F.col("first"))
            gone = gone.unionByName(late.select("id", "mark", "start", F.lit(length).alias("n")))
    return docs.select(*known, F.struct(*keep).alias("kept")) if keep else texts, gone


def _finish(docs: DataFrame, rest, schema: str, length: int, anchor: int, hot: int, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """Applies ``rest(bytes, covered)`` to each document, with what of it is repeated; ``keep`` are columns to carry along."""
    texts, gone = spans(docs, length, anchor, hot, id_col, text_col, keep)
    listed = gone.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    both = texts.join(listed.hint("merge"), ["id", "mark"], "left")

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([pa.field(x.split()[0], {"long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in schema.split(", ")])
        for b in batches:
            out = {f.name: [] for f in kinds}
            spans = b.column(2)
            flat, ends = spans.flatten(), spans.offsets.to_numpy()
            start, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n"))
            some = spans.is_valid().to_pylist()
            base = ends[0]
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
                turn = np.zeros(len(raw) + 1, np.int64)
                if some[k]:
                    s, e = start[ends[k] - base : ends[k + 1] - base], n[ends[k] - base : ends[k + 1] - base]
                    np.add.at(turn, s, 1)
                    np.add.at(turn, s + e, -1)
                for name, v in zip(out, (i, *rest(raw, np.cumsum(turn[:-1]) > 0)), strict=True):
                    out[name].append(v)
            done = pa.RecordBatch.from_pydict(out, schema=kinds)
            yield pa.RecordBatch.from_arrays([*done.columns, b.column(3)], [*done.schema.names, "kept"]) if keep else done

    if not keep:
        return both.select("id", "text", "gone").mapInArrow(run, schema)
    return both.select("id", "text", "gone", "kept").mapInArrow(run, f"{schema}, kept {both.schema['kept'].dataType.simpleString()}")


def judge(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``.

    Every byte goes that a string of ``length`` bytes covers which also begins
    earlier: in a document with a smaller id (null last), or in the same before.
    Strings are judged on the input. ``length`` may be any number from 1 to 2^20 and
    ``anchor`` from 1 to ``length``; others raise. Ids must cast to long; 2^63 - 1
    stands for null. Null texts count as empty; texts shorter than ``length`` keep
    all; long ones are read in chunks, whole. Rows with the same id and text are one document and
    get the same result; rows with the same id and different texts are ordered by
    a hash of the text. Other columns are not read; an empty table gives no rows.
    """

    def rest(raw: np.ndarray, covered: np.ndarray):
        import hashlib

        return len(raw), int(covered.sum()), int((covered & ~np.r_[False, covered[:-1]]).sum()), hashlib.sha256(raw[~covered].tobytes()).hexdigest()

    out = _finish(docs, rest, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, anchor, hot, id_col, text_col)
    return out.withColumn("id", F.nullif("id", F.lit(_LAST))).withColumnRenamed("id", id_col)


def removed(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with repeated strings taken out of their texts; see ``judge``.

    Bytes of a character that was cut go as well. ``chars_col``, if there is such
    a column, gets the length of the new text. Other columns stay as they are.
    """
    keep = [c for c in docs.columns if c not in (id_col, text_col)]

    def rest(raw: np.ndarray, covered: np.ndarray):
        return (raw[~covered].tobytes().decode("utf-8", "ignore"),)

    out = _finish(docs, rest, "id long, text string", length, anchor, hot, id_col, text_col, keep)
    new = {id_col: F.nullif("id", F.lit(_LAST)).cast(docs.schema[id_col].dataType), text_col: F.col("text")}
    kept = {c: F.length("text").cast(docs.schema[c].dataType) if c == chars_col else F.col(f"kept.{c}") for c in keep}
    return out.select(*[(new | kept)[c].alias(c) for c in docs.columns])
