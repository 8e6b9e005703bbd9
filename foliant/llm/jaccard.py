"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Texts with the same set of word shingles form a class, and only one text of a
class is compared. A class's MinHash labels are its path in each of the forest's
prefix tries. Classes that agree in the shortest prefix allowed meet in a node of
a trie; there the paths are sorted and prefixes shortened from the full depth,
label by label, until the recall estimated from the matches found reaches the
target. The shortest prefix is the one at which a pair at the threshold is found
with the target recall, so whatever is found nowhere was not lost by more.
Matches of a node (never its pairs) tie classes into clusters; within a cluster,
in blocks of bounded size, the pairs that all labels leave plausible are verified
on exact shingle sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import arrow_batches, salted, stored
from foliant.llm.components import components

WORDS, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 20, 6, 0.999999
#: Classes of a block, shingle columns of a multiplication, and classes of small clusters in a task.
BLOCK, COLUMNS, UNIT = 512, 4096, 1024
#: Rows of nodes in a task, and classes of a node whose labels are compared; those of larger nodes are tied together as they are.
NODE_ROWS, NODE = 8192, 1024
#: The chance that all labels together dismiss a pair at the threshold.
MISS = 1e-10

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64), 1)
_BASE = 0x2545F4914F6CDD1D
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(max(n, 1 << 16), np.uint64(base))
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0], _POWERS[1]


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles.

    Words are what ASCII white space separates. A text of fewer words than a
    shingle has one, of all its words; a text without words has none.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ink = np.r_[False, ~_SPACE[raw], False]
    turn = np.flatnonzero(ink[1:] != ink[:-1])
    start, end = turn[::2], turn[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    word = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    k = min(words, len(word))
    total = np.zeros(len(word) - k + 1, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + word[j : len(word) - k + 1 + j]
    return np.unique(mix(total, k))


def found_at(similarity, depth: int, trees: int):
    """The chance that a pair shares a prefix of ``depth`` labels in some trie."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold is found with the target recall; an error if there is none."""
    for d in range(depth, 0, -1):
        if found_at(threshold, d, trees) >= recall:
            return d
    raise ValueError(f"{trees} tries find a pair of similarity {threshold} with less than the target recall; take more")


def plausible(threshold: float, labels: int, miss: float = MISS) -> int:
    """So many of ``labels`` agree at least, but for a chance of ``miss`` (Chernoff's bound), where the similarity is at the threshold."""
    for c in range(int(threshold * labels), 0, -1):
        p = c / labels
        spread = p * np.log(p / threshold) + ((1 - p) * np.log((1 - p) / (1 - threshold)) if p < 1 and threshold < 1 else 0.0)
        if np.exp(-labels * spread) <= miss:
            return c
    return 0


def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64), 7) | np.uint64(1)


def signature(s: np.ndarray, factors: np.ndarray) -> bytes:
    """The MinHash labels of a set, of 2 bytes each, those of one trie side by side."""
    least = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, len(s), 2048):
        np.minimum(least, (s[lo : lo + 2048, None] * factors[None, :]).min(0), out=least)
    return (mix(least, 9) & np.uint64(0xFFFF)).astype(">u2").tobytes()


def agreeing(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many labels agree, for each row of ``one`` with each of ``other``."""
    out = np.zeros((len(one), len(other)), np.int16)
    for a, b in zip(one.T, other.T, strict=True):
        out += a[:, None] == b[None, :]
    return out


def matches(labels: np.ndarray, tree: int, trees: int, depth: int, shortest: int, threshold: float, recall: float, least: int) -> np.ndarray:
    """Which members of a node, which share ``shortest`` labels in ``tree``, are worth verifying, as a matrix.

    Paths are sorted; members are compared whose paths share a prefix, first the
    whole path, then one label less. After each step the matches so far (by their
    labels at or above the threshold), each weighed by the inverse of the chance to
    be found at this depth, and one more supposed at the threshold, estimate the
    recall; where it reaches the target, the prefix is shortened no further.
    """
    n = len(labels)
    path = labels[:, tree * depth : (tree + 1) * depth]
    order = np.lexsort(path.T[::-1])
    path = path[order]
    same = np.cumprod(path[1:] == path[:-1], axis=1).sum(1)  # labels shared with the one before
    near = np.zeros((n, n), bool)
    most = n * (n - 1) / 2
    runs: set[tuple[int, int]] = set()
    for d in range(depth, shortest - 1, -1):
        worst = 1 / float(found_at(threshold, d, trees))
        if d > shortest and (most + 1) / (most + worst) < recall:
            continue  # so few members cannot reach the target at this depth
        first = np.flatnonzero(np.r_[True, same < d])
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), n], strict=True):
            if hi - lo > 1 and (lo, hi) not in runs:
                runs.add((lo, hi))
                at = order[lo:hi]
                near[np.ix_(at, at)] = agreeing(labels[at], labels[at]) >= least
        if d == shortest:
            break
        i, j = np.nonzero(np.triu(near, 1))
        likely = np.zeros(len(i))
        for lo in range(0, len(i), 1 << 14):
            likely[lo : lo + (1 << 14)] = (labels[i[lo : lo + (1 << 14)]] == labels[j[lo : lo + (1 << 14)]]).mean(1)
        likely = likely[likely >= threshold]
        if (len(likely) + 1) / ((1 / found_at(likely, d, trees)).sum() + worst) >= recall:
            break
    np.fill_diagonal(near, False)
    return near


def _key(s: np.ndarray) -> bytes:
    """A hash of 128 bits of a shingle set."""
    return b"".join([mix(s, salt).sum(dtype=np.uint64).tobytes() for salt in (3, 5)])


def verified(sizes: np.ndarray, sets: list[np.ndarray], threshold: float, worth: np.ndarray) -> np.ndarray:
    """Which of the pairs ``worth`` verifying have that Jaccard similarity; exact. Shingles of one row alone cannot add to an intersection."""
    n = len(sets)
    i, j = np.nonzero(np.triu(worth, 1))
    linked = np.zeros((n, n), bool)
    if len(i) <= 4 * n:  # few: pair by pair
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = (sets[a], sets[b]) if sizes[a] <= sizes[b] else (sets[b], sets[a])
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            linked[a, b] = linked[b, a] = both > 0 and both >= threshold * (sizes[a] + sizes[b] - both) - 1e-6
        return linked
    row = np.repeat(np.arange(n), sizes)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    row, col = row[shared], col[shared]
    col = (np.cumsum(count > 1) - 1)[col]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        a, b = np.searchsorted(col, [lo, lo + COLUMNS])
        m = np.zeros((n, COLUMNS), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        both += m @ m.T
    union = sizes[:, None] + sizes[None, :] - both
    return worth & (both > 0) & (both >= threshold * union - 1e-6)


def _least(linked: np.ndarray) -> np.ndarray:
    """For each row the first row that it reaches through links."""
    least = np.arange(len(linked))
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], len(linked)).min(1, initial=len(linked)))
        new = np.minimum(new, new[new])
        if (new == least).all():
            return least
        least = new


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, classes) of a self-join on Jaccard similarity of word shingles.

    members: (id, key), a row for each row of ``docs``; key names the class of
    rows with the same shingle set. classes: (key, same_id, n_copies, n_links,
    class_id), a row a class: the least id in it, its rows, the number of other
    classes that it is similar to, and the least id of all classes that it is
    connected to by such links, itself included.

    Null texts count as empty. Texts without words form one class, without links.
    Ids must be whole numbers; a class without any id has null ids and makes no
    links. An id may occur with several texts: each belongs to its own class.
    Repeated rows are copies. Other columns are not read; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    cut, least = prefix_depth(threshold, trees, depth, recall), plausible(threshold, trees * depth)
    factors = _factors(trees * depth)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def signed(batches):
        import pyarrow as pa

        for b in batches:
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            paths = pa.array([signature(s, factors) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_key(s) for s in sets], pa.binary()), paths], ["id", "key", "labels"])

    seen = stored(base.mapInArrow(signed, "id long, key binary, labels binary"), "signatures")
    classes = stored(seen.groupBy("key").agg(F.min("id").alias("same_id"), F.count("*").alias("n_copies"), F.first("labels").alias("labels")), "classes")
    prefix = lambda t: F.xxhash64(t, F.col("labels").substr(t * (2 * depth) + 1, F.lit(2 * cut)))
    node = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(prefix(t).alias("node"), t.alias("tree")))
    nodes = classes.filter("same_id IS NOT NULL AND labels IS NOT NULL").select("key", F.explode(node).alias("at")).select("key", "at.node", "at.tree")
    shared = nodes.groupBy("node").agg(F.min("key").alias("least"), F.count("*").alias("n")).filter("n > 1")
    met = stored(salted(nodes, shared, "node"), "nodes")
    rows = met.filter(F.col("n") <= NODE)
    units = max(1, rows.count() // NODE_ROWS)

    def tied(table):
        import pyarrow as pa

        node, tree = table["node"].to_numpy(), table["tree"].to_numpy()
        order = np.argsort(node, kind="stable")
        keys = table["key"].take(pa.array(order)).to_pylist()
        labels = np.frombuffer(b"".join(table["labels"].take(pa.array(order)).to_pylist()), ">u2").astype(np.uint16).reshape(len(order), -1)
        node, tree = node[order], tree[order]
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.r_[first, len(node)])
        two = first[size == 2]
        two = two[(labels[two] == labels[two + 1]).sum(1) >= least]
        edges = {(keys[k], keys[k + 1]) for k in two.tolist()}
        for lo, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            to = _least(matches(labels[lo : lo + n], int(tree[lo]), trees, depth, cut, threshold, recall, least))
            edges.update((keys[lo + k], keys[lo + m]) for k, m in enumerate(to.tolist()) if k != m)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.binary()), "b": pa.array([e[1] for e in edges], pa.binary())})

    held = rows.select("key", "node", "tree").join(classes.select("key", "labels").hint("merge"), "key").withColumn("unit", F.pmod(F.xxhash64("node"), F.lit(units)))
    edges = held.groupBy("unit").applyInArrow(tied, "a binary, b binary").unionByName(met.filter(F.col("n") > NODE).select(F.col("key").alias("a"), F.col("least").alias("b")))
    found = components(edges)
    sized = found.groupBy("component").agg(F.count("*").alias("size"))
    near = salted(found, sized, "component").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    near = near.select(F.col("node").alias("key"), F.xxhash64("component").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    near = stored(near.join(classes.select("key", "same_id", "labels").hint("merge"), "key"), "clusters")
    groups = max(1, near.count() // UNIT)

    def exact(batches):
        import pyarrow as pa

        for b in batches:
            sets, keep = [], []
            for i, (t, key) in enumerate(zip(b.column(5).to_pylist(), b.column(0).to_pylist(), strict=True)):
                if _key(s := shingles(t, words)) == key:  # another text may have the same id
                    sets.append(s.tobytes())
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(5)), pa.array(sets, pa.binary())], ["key", "cluster", "blocks", "block", "labels", "set"])

    texts = near.withColumnRenamed("same_id", "id").join(base.hint("merge"), "id")
    sets = texts.select("key", "cluster", "blocks", "block", "labels", "text").mapInArrow(exact, "key binary, cluster long, blocks int, block int, labels binary, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = sets.withColumn("other", other).select(
        F.when(F.col("blocks") == 1, F.pmod("cluster", F.lit(groups))).otherwise(F.col("cluster")).alias("unit"), "blocks",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", "cluster", "block", "labels", "set",
    )

    def compared(table):
        import pyarrow as pa

        keys, cluster, block = table["key"].to_pylist(), table["cluster"].to_numpy(), table["block"].to_numpy()
        held = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
        labels = np.frombuffer(b"".join(table["labels"].to_pylist()), ">u2").astype(np.uint16).reshape(len(keys), -1)
        cross = table["low"][0].as_py() != table["high"][0].as_py()
        by_key = sorted(range(len(keys)), key=lambda k: keys[k])
        order = np.array(by_key)[np.argsort(cluster[by_key], kind="stable")]
        out = [], [], []
        for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            rows = rows[[k == 0 or keys[r] != keys[rows[k - 1]] for k, r in enumerate(rows.tolist())]]  # repeated rows of an id
            if len(rows) < 2:
                continue
            worth = agreeing(labels[rows], labels[rows]) >= least
            np.fill_diagonal(worth, False)
            if cross:
                worth &= block[rows][:, None] != block[rows][None, :]
            linked = verified(np.array([len(held[r]) for r in rows]), [held[r] for r in rows], threshold, worth)
            degree, to = linked.sum(1), _least(linked)
            for k in np.flatnonzero(degree).tolist():
                for v, x in zip(out, (keys[rows[k]], int(degree[k]), keys[rows[to[k]]]), strict=True):
                    v.append(x)
        return pa.table({"key": pa.array(out[0], pa.binary()), "n_links": pa.array(out[1], pa.int64()), "root": pa.array(out[2], pa.binary())})

    links = stored(tasks.groupBy("unit", "blocks", "low", "high").applyInArrow(compared, "key binary, n_links long, root binary"), "links")
    degree = links.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    groups_of = components(links.select(F.col("key").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("key"), "component")
    known = degree.join(groups_of.hint("merge"), "key").join(classes.select("key", "same_id").hint("merge"), "key")
    firsts = known.groupBy("component").agg(F.min("same_id").alias("class_id"))
    known = stored(salted(known, firsts, "component").select("key", "n_links", "class_id"), "groups")
    full = classes.select("key", "same_id", "n_copies").join(known.hint("merge"), "key", "left")
    full = full.select("key", "same_id", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("class_id", "same_id").alias("class_id"))
    return seen.select(F.col("id").alias(id_col), "key"), full


def linked(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Rows (id, class_id, n_copies, n_links, same_id) for each row of ``docs``; see ``join``."""
    members, classes = join(docs, id_col=id_col, **how)
    return salted(members, classes, "key").select(id_col, "class_id", "n_copies", "n_links", "same_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` with the least id of each group of texts that links connect.

    Rows with the same id stay or go together: they stay if the id is the least
    of a group of one of their texts. Rows without id stay.
    """
    _, classes = join(docs, id_col=id_col, **how)
    stay = classes.filter("class_id IS NOT NULL").select(F.col("class_id").alias(id_col)).distinct()
    return docs.join(stay.hint("merge"), id_col, "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))
