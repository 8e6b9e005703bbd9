"""Quality scores from compression with two zstandard dictionaries.

One dictionary is built from blocks of good labelled text and one from bad. A
text compresses better with the dictionary of its kind; the normalised
difference of its two compressed sizes, calibrated by a logistic curve, is its
score. Texts are compressed whole, in blocks, so that the dictionaries matter as
much at the end of a long text as at its beginning.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import arrow_batches, stored

#: Defaults of the bounds of the fit (labelled rows of a class, blocks of a class), bytes of a block and of a dictionary.
SAMPLE_ROWS, SAMPLE_BLOCKS, BLOCK, DICTIONARY = 6000, 10_000, 512, 110_000
LEVEL = 1


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the coefficients of the logistic curve."""

    good: bytes
    bad: bytes
    curve: tuple[float, ...]


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes):
    import zstandard

    def make(content: bytes):
        if not content:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)

    return make(good), make(bad)


def features(texts: list[str], good: bytes, bad: bytes) -> np.ndarray:
    """For each text: 1, the difference of its compressed sizes over their sum, and the same times the logarithm of its length (the same difference is surer of a longer text)."""
    g, b = _compressors(good, bad)
    out = np.ones((len(texts), 3))
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        x = sum([len(g.compress(k)) for k in blocks])
        y = sum([len(b.compress(k)) for k in blocks])
        d = (y - x) / max(x + y, 1)
        out[i, 1:] = d, d * np.log1p(len(raw))
    return out


def _dictionary(blocks: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:  # too few blocks to choose from: an equal part of each
        return b"".join([x[: DICTIONARY // len(blocks)] for x in blocks])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps, with a small penalty."""
    mean, sd = x.mean(0), x.std(0)
    mean[0], sd = 0.0, np.where(sd > 0, sd, 1.0)
    z, c = (x - mean) / sd, np.zeros(x.shape[1])
    pull = ridge * w.sum() * np.eye(len(c))
    pull[0, 0] *= 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -35, 35)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + pull + 1e-9 * np.eye(len(c)), z.T @ (w * (y - p)) - pull @ c)
        c = c + step
        if np.abs(step).max() < 1e-9:
            break
    c = c / sd
    c[0] -= float((c[1:] * mean[1:]).sum())
    return tuple(float(v) for v in c)


def held_out(id_col: str = "doc_id"):
    """True for the third of the ids that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_blocks: int = SAMPLE_BLOCKS, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from labelled rows outside the held-out third.

    The fit, and nothing but the fit, is on a sample: at most ``sample_rows``
    labelled rows of each class, chosen by a hash of the id; one half (by hash of
    the text, so copies stay together) gives at most ``sample_blocks`` blocks of a
    class, chosen by a hash, to the dictionaries, the other calibrates, weighted
    to the share of the classes among all labels. Labels that are neither 0 nor 1 are left out; of several
    labels of an id the least holds. Without rows of both classes the score is
    the share of good labels, 0.5 if there are none. Where there are too few blocks
    to train a dictionary from, it is made of the beginnings of the blocks, an equal
    part of each; that bounds the fit alone, texts are scored whole. The score comes
    from the size difference only, but it is surer of a longer text, as the
    difference also counts times the logarithm of the length.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    known = stored(known, "labels")
    shares = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    constant = Model(b"", b"", (float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), 0.0, 0.0))
    if len(shares) < 2:
        return constant
    order = [F.xxhash64(F.lit(1), "id"), "id"]
    chosen = known.filter("label = 0").orderBy(*order).limit(sample_rows).unionByName(known.filter("label = 1").orderBy(*order).limit(sample_rows))
    # at most 2 * sample_rows pairs of numbers are broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("label", "text")
    texts = stored(texts, "labelled")
    half = F.pmod(F.xxhash64("text"), F.lit(2))

    def blocks(batches):
        import pyarrow as pa

        for b in batches:
            label, cut = [], []
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = t.encode()
                new = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
                cut += new
                label += [y] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(cut, pa.binary())], ["label", "block"])

    cut = texts.filter(half == 0).mapInArrow(blocks, "label int, block binary")
    bad, good = ([bytes(r[0]) for r in cut.filter(F.col("label") == y).orderBy(F.xxhash64("block"), "block").limit(sample_blocks).select("block").collect()] for y in (0, 1))
    good, bad = _dictionary(good), _dictionary(bad)

    def measure(batches):
        import pyarrow as pa

        for b in batches:
            x = features(b.column(1).to_pylist(), good, bad)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    rows = texts.filter(half == 1).orderBy(F.xxhash64("text", F.lit(2))).limit(2 * sample_rows).mapInArrow(measure, "label int, x array<double>").collect()
    y = np.array([r[0] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return constant
    x = np.array([r[1] for r in rows])
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(good, bad, _logistic(x, y, w))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, score, predicted) for each row of ``docs``; null texts count as empty.

    A score depends on the text alone, so equal texts have equal scores. Repeated
    rows stay, other columns are not read, an empty table gives no rows. Rows are
    scored where they are read: no shuffle.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        curve = np.array(model.curve)
        for b in batches:
            x = features([t or "" for t in b.column(1).to_pylist()], model.good, model.bad)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ curve, -35, 35))))], ["id", "score"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def rejected_removed(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts score 0.5 or more.

    Null texts count as empty, long ones are read whole, and repeated rows are kept
    or go alike; an empty table gives none.
    """
    arrow_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        curve = np.array(model.curve)
        for b in batches:
            x = features([t or "" for t in b.column(at).to_pylist()], model.good, model.bad)
            yield b.filter(pa.array(x @ curve >= 0))

    return docs.mapInArrow(run, docs.schema)
