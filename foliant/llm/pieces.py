"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The flat symbol array of many words is merged in rounds: each round finds the
least pair rank of every word (a segmented minimum), merges it where it occurs
(leftmost first), and compacts the array, until no pair of any word remains.

Words are cut before a run of word-start marks that follows another character,
and around characters that occur in no longer piece. No piece crosses such a
cut (checked when a model is loaded), so each word can be encoded alone and the
result of a frequent word is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import arrow_batches

MARK = "▁"
MARK_BYTES = MARK.encode()
NONE = np.int64(1) << 40
#: Words that a Python worker keeps, at most.
KEPT_WORDS = 500_000
#: Longer words are not kept.
KEPT_BYTES = 64


class PieceModel:
    """Tables of one BPE model file with byte fallback and no normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.size = size
        pieces = [lib.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {pieces[i]: i for i in plain}
        scores = {i: lib.get_score(i) for i in plain}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(size):
            if lib.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        # what an id stands for, as bytes; unknown and control ids stand for nothing
        self.surface = [b""] * size
        for i in plain:
            self.surface[i] = pieces[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        self.unknown = size
        self.symbol = np.full(0x110000, self.unknown, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        keys, ranks, merged, inner = [], [], [], set()
        for p, i in self.ids.items():
            if MARK in p.lstrip(MARK):
                raise ValueError("a piece holds a word-start mark after another character")
            inner.update(p if len(p) > 1 else "")
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * (size + 1) + b)
                    ranks.append(order[scores[i]])
                    merged.append(i)
        sort = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[sort]
        self.ranks = np.array(ranks, np.int64)[sort]
        self.merged = np.array(merged, np.int32)[sort]
        self._index()
        self.pairs = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.merged, strict=True)}
        self.alone = "".join(c for c in "\n\t\r\v\f" if c not in inner)
        alone = re.escape(self.alone)
        self.words = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))

    def _index(self) -> None:
        """Two hash tables over the pairs: the second has those that another pair displaced from the first."""
        mult, n = 0x9E3779B97F4A7C15, len(self.keys)
        self.first, self.second = np.full(1 << 21, n, np.int32), np.full(1 << 18, n, np.int32)
        at = (self.keys.astype(np.uint64) * np.uint64(mult)) >> np.uint64(43)
        self.first[at] = np.arange(n)
        rest = np.flatnonzero(self.first[at] != np.arange(n))
        self.mult = np.uint64(mult)
        while True:  # another factor, until none of the few is displaced again
            mult = (mult * 0xD6E8FEB86659FD93 + 2) & 0xFFFFFFFFFFFFFFFF | 1
            self.other = np.uint64(mult)
            at = (self.keys[rest].astype(np.uint64) * self.other) >> np.uint64(46)
            if len(np.unique(at)) == len(rest):
                break
        self.second[at] = rest
        self.keys, self.ranks, self.merged = np.r_[self.keys, -1], np.r_[self.ranks, NONE], np.r_[self.merged, np.int32(0)]

    def split(self, text: str) -> list[str]:
        """The words of a text, with its word-start mark; none for an empty text."""
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is no such pair) and merged symbol of pairs."""
        key = left.astype(np.int64) * (self.size + 1) + right
        at = self.first[(key.view(np.uint64) * self.mult) >> np.uint64(43)]
        if (miss := np.flatnonzero(self.keys[at] != key)).size:
            again = self.second[(key[miss].view(np.uint64) * self.other) >> np.uint64(46)]
            at[miss] = np.where(self.keys[again] == key[miss], again, len(self.keys) - 1)
        return self.ranks[at], self.merged[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all words in order, the code point each begins with, and each word's first symbol."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, at = self.symbol[chars], np.arange(len(chars))
        word = np.repeat(np.arange(len(words)), lengths)
        done_at, done_sym = [], []
        rank, new = np.full(len(sym), NONE), np.zeros(len(sym), np.int32)
        fresh = np.flatnonzero(word[1:] == word[:-1])  # pairs, by their left symbol, that are not looked up yet
        while len(sym):
            if len(fresh):
                rank[fresh], new[fresh] = self._find(sym[fresh], sym[fresh + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            seg = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(sym)]))
            live = (least < NONE)[seg]
            if not live.all():
                done_at.append(at[~live])
                done_sym.append(sym[~live])
                sym, at, word, rank, new, seg = (x[live] for x in (sym, at, word, rank, new, seg))
                if not len(sym):
                    break
            chosen = self._choose(sym, word, rank, new, seg, least)
            sym[chosen] = new[chosen]
            keep = np.ones(len(sym), bool)
            keep[chosen + 1] = False
            rank[chosen] = NONE
            moved = np.cumsum(keep)[chosen] - 1
            sym, at, word, rank, new = (x[keep] for x in (sym, at, word, rank, new))
            left = moved[moved > 0] - 1
            left = left[word[left] == word[left + 1]]
            rank[left] = NONE
            right = moved[moved < len(sym) - 1]
            due = np.zeros(len(sym), bool)
            due[left] = due[right[word[right] == word[right + 1]]] = True
            fresh = np.flatnonzero(due)
        if not done_at:
            return np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(len(words) + 1, np.int64)
        at, sym = np.concatenate(done_at), np.concatenate(done_sym)
        order = np.argsort(at, kind="stable")
        at, sym = at[order], sym[order]
        return sym, chars[at], np.searchsorted(at, np.r_[0, np.cumsum(lengths)])

    def _choose(self, sym, word, rank, new, seg, least) -> np.ndarray:
        """Where to merge in this round: each word's least pair, at every place that gives what one place after another would."""
        c = np.flatnonzero(rank == least[seg])
        run = np.r_[True, c[1:] != c[:-1] + 1]
        c = c[(np.arange(len(c)) - np.maximum.accumulate(np.where(run, np.arange(len(c)), 0))) % 2 == 0]
        s = seg[c]
        many = np.r_[False, s[1:] == s[:-1]]
        if not many.any():
            return c
        crowded = np.unique(s[many])
        d = c[np.isin(s, crowded)]
        # the symbols beside each new one, at the time when it is made
        left = np.where(d > 0, sym[d - 1], self.unknown)
        prior = np.r_[False, d[1:] == d[:-1] + 2]
        left = np.where(prior, np.r_[0, new[d[:-1]]], left)
        left = np.where((d > 0) & (word[d - 1] == word[d]), left, self.unknown)
        after = np.minimum(d + 2, len(sym) - 1)
        right = np.where((d + 2 < len(sym)) & (word[after] == word[d]), sym[after], self.unknown)
        soon = np.minimum(self._find(left, new[d])[0], self._find(new[d], right)[0])
        unsafe = np.unique(seg[d][soon <= least[seg[d]]])
        return c[~(many & np.isin(s, unsafe))] if len(unsafe) else c

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Token ids of all words, and where each word's begin and the last ends; a character without a piece becomes the ids of its bytes."""
        sym, chars, first = self.merge(words)
        if (odd := np.flatnonzero(sym == self.unknown)).size:
            raw = [chr(x).encode("utf-8", "surrogatepass") for x in chars[odd]]
            count = np.ones(len(sym), np.int64)
            count[odd] = [len(x) for x in raw]
            start = np.r_[0, np.cumsum(count)]
            ids = np.repeat(sym, count)
            ids[np.repeat(start[odd], count[odd]) + np.concatenate([np.arange(len(x)) for x in raw])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            sym, first = ids, start[first]
        return sym, first.tolist()

    def encode(self, text: str) -> list[int]:
        return self.encode_flat(self.split(text))[0].tolist()

    def decode(self, ids) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
        return decoded([self.surface[i] for i in ids])


def decoded(surfaces: list[bytes]) -> str:
    """The text of what tokens stand for: without the blank put before the first word; bytes that are no UTF-8 become U+FFFD."""
    out = b"".join(surfaces)
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str | None = None) -> PieceModel:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return PieceModel(path)


class WordCache:
    """What ``of(ids, bounds)`` makes of each word's ids, or ``of(words)`` of the words themselves, kept for the words seen last.

    Texts are cut into words by a few passes over their bytes, and the words of a
    batch are made distinct by Arrow's dictionary encoding, so that Python meets
    a word once a batch, however often it occurs there.
    """

    def __init__(self, model: PieceModel, of, most: int = KEPT_WORDS, split_only: bool = False):
        self.model, self.most, self.known, self.older = model, most, {}, {}
        self.of = of if split_only else lambda words: of(*model.encode_flat(words))
        self.alone = np.zeros(256, bool)
        self.alone[[ord(c) for c in model.alone]] = True

    def _words(self, raws: list[bytes]):
        """(distinct words, the place among them of each word, where each text's words begin and the last's end)."""
        import pyarrow as pa

        some = [k for k, x in enumerate(raws) if x]
        data = b"".join([b" " + (x.replace(MARK_BYTES, b" ") if MARK_BYTES in x else x) for x in (raws[k] for k in some)])
        raw = np.frombuffer(data, np.uint8)
        gap, lone = raw == 32, self.alone[raw]
        begin = lone.copy()
        begin[1:] |= lone[:-1] | (gap[1:] & ~gap[:-1])
        extra = np.array([raws[k].count(MARK_BYTES) for k in some], np.int64) * (len(MARK_BYTES) - 1)
        sizes = np.array([len(raws[k]) + 1 for k in some], np.int64) - extra
        at = np.cumsum(sizes) - sizes
        begin[at] = True
        starts = np.flatnonzero(begin)
        offsets = np.r_[starts, len(raw)].astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        bounds = np.zeros(len(raws) + 1, np.int64)
        bounds[np.array(some, np.int64) + 1] = np.diff(np.r_[np.searchsorted(starts, at), len(starts)])
        distinct = words.dictionary
        kept, cuts = distinct.buffers()[2].to_pybytes(), np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1].tolist()
        return [kept[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], words.indices.to_numpy(), np.cumsum(bounds)

    def batch(self, raws: list[bytes]) -> tuple[list, np.ndarray, np.ndarray]:
        """(values, place, bounds): text k's words have the values at place[bounds[k] : bounds[k + 1]]."""
        words, place, bounds = self._words(raws)
        if 2 * len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        values = list(map(known.get, words))
        missing = [k for k, v in enumerate(values) if v is None]
        if older:
            for k in missing:
                if (v := older.get(words[k])) is not None:
                    values[k] = known[words[k]] = v
            missing = [k for k in missing if values[k] is None]
        lo = 0
        while lo < len(missing):  # by as many words as the processor's caches hold
            hi, size = lo, 0
            while hi < len(missing) and (hi == lo or size < 400_000):
                size += sum([len(words[k]) for k in missing[hi : hi + 1000]])
                hi += 1000
            some = missing[lo:hi]
            new = [words[k] for k in some]
            joined = b"\0".join(new)
            if joined.count(0) == len(new) - 1:
                texts = joined.decode("utf-8", "surrogatepass").replace(" ", MARK).split("\0")
            else:  # a text holds the separator
                texts = [w.decode("utf-8", "surrogatepass").replace(" ", MARK) for w in new]
            for k, w, v in zip(some, new, self.of(texts), strict=True):
                values[k] = v
                if len(w) <= KEPT_BYTES:
                    known[w] = v
            lo = hi
        return values, place, bounds

    def texts(self, texts: list[str], at_once: int = 512) -> Iterator[list]:
        """For each text, the values of its words."""
        for lo in range(0, len(texts), at_once):
            values, place, bounds = self.batch([t.encode("utf-8", "surrogatepass") for t in texts[lo : lo + at_once]])
            place = place.tolist()
            for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                yield [values[k] for k in place[a:b]]


def gathered(values: list[bytes], place: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the values at ``place``, one after another, and where each value's begin and the last's end."""
    flat = np.frombuffer(b"".join(values), kind)
    size = np.fromiter(map(len, values), np.int64, len(values)) // int(kind[-1])
    start, n = np.cumsum(size) - size, size[place]
    ends, out = np.cumsum(n), []
    for lo in range(0, len(place), 1 << 19):
        m = n[lo : lo + (1 << 19)]
        move = start[place[lo : lo + (1 << 19)]] - (np.cumsum(m) - m)
        out.append(flat[np.repeat(move, m) + np.arange(int(m.sum()))])
    return np.concatenate(out) if out else flat[:0], np.r_[0, ends]


def as_bytes(kind: str):
    """Each word's ids as little-endian numbers, for ``WordCache``."""
    width = int(kind[-1])

    def of(ids: np.ndarray, bounds: list[int]) -> list[bytes]:
        raw = ids.astype(kind).tobytes()
        return [raw[width * a : width * b] for a, b in zip(bounds, bounds[1:], strict=False)]

    return of


def as_text(model: PieceModel):
    """Each word's ids in decimal, their number, and what they decode to."""

    def of(ids: np.ndarray, bounds: list[int]) -> list[tuple[str, int, bytes]]:
        ids = ids.tolist()
        names, surfaces = list(map(str, ids)), [model.surface[i] for i in ids]
        return [(",".join(names[a:b]), b - a, b"".join(surfaces[a:b])) for a, b in zip(bounds, bounds[1:], strict=False)]

    return of


def as_both(model: PieceModel):
    """Each word's ids as little-endian numbers of 4 bytes, and what they decode to."""

    def of(ids: np.ndarray, bounds: list[int]) -> list[tuple[bytes, bytes]]:
        raw, surfaces = ids.astype("<i4").tobytes(), [model.surface[i] for i in ids.tolist()]
        return [(raw[4 * a : 4 * b], b"".join(surfaces[a:b])) for a, b in zip(bounds, bounds[1:], strict=False)]

    return of


def utf8(column) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; nulls are empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_CACHES: dict = {}


def cache(path: str | None, kind: str, of, split_only: bool = False) -> WordCache:
    """A Python worker keeps its caches from task to task."""
    if (path, kind) not in _CACHES:
        _CACHES[path, kind] = WordCache(load(path), of, split_only=split_only)
    return _CACHES[path, kind]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, ids array<int>, decoded string) for each row of ``docs``, and its columns ``keep``.

    Null texts count as empty; an empty text has no ids and decodes to an empty
    text. Repeated rows stay. Other columns of ``docs`` are not read. Rows are
    encoded where they are read: no shuffle.
    """
    arrow_batches(docs.sparkSession)
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    names = list(kinds)

    def run(batches):
        import pyarrow as pa

        words = cache(path, "both", as_both(load(path)))
        for b in batches:
            values, place, bounds = words.batch(utf8(b.column(0)))
            ids, at = gathered([v[0] for v in values], place, "<i4")
            surface, spots = [v[1] for v in values], place.tolist()
            back = [decoded([surface[k] for k in spots[lo:hi]]) for lo, hi in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.ListArray.from_arrays(pa.array(at[bounds].astype(np.int32)), pa.array(ids, pa.int32())), pa.array(back, pa.string())], [*names, "ids", "decoded"])

    return docs.select(F.col(text_col).alias("_text"), *kinds).mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, but only (id, n_tokens, ids_sha256, decoded_sha256): ids and decoded texts stay in the task."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import hashlib

        import pyarrow as pa

        model = load(path)
        words = cache(path, "text", as_text(model))
        for b in batches:
            n, ids, back = [], [], []
            values, place, bounds = words.batch(utf8(b.column(1)))
            names, counts, surface = ([v[k] for v in values] for k in range(3))
            total = np.r_[0, np.cumsum(np.array(counts, np.int64)[place])] if len(place) else np.zeros(1, np.int64)
            n, spots = np.diff(total[bounds]), place.tolist()
            for lo, hi in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                mine = spots[lo:hi]
                ids.append(hashlib.sha256(",".join([names[k] for k in mine]).encode()).hexdigest())
                back.append(hashlib.sha256(decoded([surface[k] for k in mine]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
