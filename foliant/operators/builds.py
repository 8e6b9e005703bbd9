"""Corpora built in one go, and measures of rewritten texts: weak labels of six heads, quotas with top-up, splits, entity-safe pairs, thresholds by class, BLEU and ROUGE."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from foliant.functions import text as T
from foliant.operators import claims, corpus, cuts, edits, evaluate
from foliant.sources.shared import stored

# Cues of the six heads.
STRUCTURE = r"we\s+(?:propose|present|introduce|develop|evaluate|conduct)|methods?|methodology|experimental\s+setup|results?\s+(?:show|indicate|demonstrate)|in\s+this\s+(?:paper|work|study)|contributions?\s+(?:are|is)|dataset|benchmark|evaluation"
NUMBER = r"n\s*=\s*\d+|p\s*[<≈=]\s*0?\.\d+|95\s*%\s*CI|\d+(?:\.\d+)?\s*%[A-Za-z0-9_]|±\s*\d|accuracy|f1|auc|bleu|rouge|iou"
NOVELTY = r"to\s+the\s+best\s+of\s+our\s+knowledge|for\s+the\s+first\s+time|(?:a\s+)?novel\s+(?:approach|method|framework|algorithm|technique|model)|no\s+previous\s+(?:work|study)\s+has|fills?\s+an?\s+important\s+gap"
NOVELTY_SHOWN = r"compared\s+(?:to|with|against)|unlike\s+(?:prior|previous|earlier)"
GAIN = claims.GAIN
VAGUE = r"(?:standard|conventional|usual)\s+(?:methods?|procedures?|protocols?)\s+(?:were|was)\s+(?:used|followed|applied)|(?:carefully|properly|thoroughly)\s+(?:performed|conducted)"
CONCRETE = r"trained|fine[- ]tuned|optimized|implemented|sampled|annotated|hyperparameter|batch\s+size|learning\s+rate|epochs?|cross[- ]validation|ablation|baseline"
CRAFT_MARK, CRAFT = r"\[\d+(?:\s*[,;-]\s*\d+)*\]", r"IEEE|MIMO|OFDM|SNR|BER|FPGA|SoC|beamforming|wireless|convolutional|transformer|neural\s+network"
CITED = r"\[\d+(?:\s*[,;-]\s*\d+)*\]|\([A-Z][A-Za-z'-]+(?:\s+et\s+al\.?)?,?\s*\d{4}"
HEADS = ["structure_ok", "numerical_clear", "novelty_ok", "methods_concrete", "selective_ready", "ieee_craft"]


def head_labels(text="text") -> Column:
    """Weak labels of six heads, array of 0 and 1: structure, numbers, novelty, methods, a composite of these, engineering craft."""
    t = T.col(text)
    like = lambda p: t.rlike(T.words_like(p)).cast("int")
    structure, number = like(STRUCTURE), like(NUMBER)
    novelty = 1 - ((like(NOVELTY) == 1) & (like(NOVELTY_SHOWN) == 0) & ~t.rlike(GAIN)).cast("int")
    methods = F.when(like(VAGUE) == 1, 0).otherwise(like(CONCRETE))
    craft = (t.rlike(CRAFT_MARK) | (like(CRAFT) == 1)).cast("int")
    points = structure + number + novelty + methods + F.when(t.rlike(CITED), 0.5).otherwise(0.0)
    return F.array(structure, number, novelty, methods, ((points >= 3.5) & (novelty == 1)).cast("int"), craft)


def seeded(seed: str, key: str) -> Column:
    """A seeded order as a key for cuts: by MD5, then by the row's own key."""
    return F.concat_ws(":", corpus.order(F.lit(seed), key), F.col(key).cast("string"))


def quota(rows: DataFrame, want: dict[tuple, int], by: list[str], seed: str, key: str, written: bool = False) -> DataFrame:
    """Of each bucket (values of ``by``) as many rows as ``want`` says, in a seeded order; buckets not named give none. ``written``: see ``cuts.least``."""
    named = {":".join(str(x).lower() if isinstance(x, bool) else str(x) for x in k): n for k, n in want.items()}
    bucketed = rows.withColumn("_bucket", F.concat_ws(":", *[F.col(c).cast("string") for c in by]))
    return cuts.least(bucketed, named, "_bucket", seeded(seed, key), written).drop("_bucket")


def bucket_counts(rows: DataFrame, by: list[str]) -> dict[tuple, int]:
    """Rows of each bucket; one row a bucket comes to the driver, and a bucket is a label or two."""
    return {tuple(r[c] for c in by): r["n"] for r in rows.groupBy(*by).agg(F.count("*").alias("n")).collect()}


def balanced_with_hard(rows: DataFrame, positives: float = 0.7, negatives: float = 0.55, seed: str = "5", key: str = "row_id") -> DataFrame:
    """Rows (label, hard, ...) of equal classes: k of each, k the rows of the rarer one.

    Of k positives at most 0.7 k are hard, of negatives 0.55 k; what one kind lacks
    the other tops up.
    """
    n = bucket_counts(rows, ["label", "hard"])
    k = min(n.get((y, True), 0) + n.get((y, False), 0) for y in (0, 1))
    want = {}
    for y, share in ((1, positives), (0, negatives)):
        hard = min(n.get((y, True), 0), int(k * share))
        soft = min(n.get((y, False), 0), k - hard)
        want |= {(y, True): min(n.get((y, True), 0), k - soft), (y, False): soft}
    return quota(rows, want, ["label", "hard"], seed, key)


def half_and_half(rows: DataFrame, head: str, size: int, seed: str = "6", key: str = "row_id") -> DataFrame:
    """``size`` rows, half of them with ``head`` 1, half 0; what one half lacks comes from the rest."""
    n = bucket_counts(rows, [head])
    ones, zeros = n.get((1,), 0), n.get((0,), 0)
    a, b = min(ones, size // 2), min(zeros, size - size // 2)
    return quota(rows, {(1,): min(ones, size - b), (0,): min(zeros, size - a)}, [head], seed, key)


def capped_by(rows: DataFrame, caps: dict[str, int], by: str, seed: str, key: str) -> DataFrame:
    """At most so many rows of each value of a column, in a seeded order; values without a cap, and nulls, keep all."""
    held = F.coalesce(F.col(by).isin(list(caps)), F.lit(False))
    return cuts.least(rows.filter(held), caps, by, seeded(seed, key)).unionByName(rows.filter(~held))


def seeded_cap(rows: DataFrame, most: int, seed: str, key: str) -> DataFrame:
    """``most`` rows in a seeded order, without replacement: the limit is the operator."""
    return cuts.least(rows, {"all": most}, None, seeded(seed, key))


def hardest(rows: DataFrame, most: int, others: int, seed: str, key: str, hardness: str = "hardness", top: float = 1.25) -> DataFrame:
    """The ``most`` rows of greatest hardness (0 to ``top``, ties to the smaller key) and ``others`` of the rest in a seeded order; ``pick`` says which."""
    order = F.concat_ws(":", cuts.falling(F.col(hardness), top), F.lpad(F.col(key).cast("string"), 20, "0"))
    kept = stored(rows.withColumn("_order", order), "hardness")
    bound = cuts.nth_keys(kept, {"all": most}, None, "_order").get("all")
    hard = F.lit(most > 0) if bound is None else F.col("_order") <= F.lit(bound)
    rest = cuts.least(kept.filter(~hard), {"all": others}, None, seeded(seed, key))
    return kept.filter(hard).withColumn("pick", F.lit("hard")).unionByName(rest.withColumn("pick", F.lit("random"))).drop("_order")


# Sentences that a clause is set into, for each label; the second set is for evaluation alone.
TEMPLATES = {
    "novelty": [
        "To the best of our knowledge, {clause}.", "For the first time, {clause}.", "We propose a novel approach whereby {clause}.", "This paper presents a novel method in which {clause}.", "No previous work has addressed the setting where {clause}.",
        "Our unique contribution is that {clause}.", "We are the first to show that {clause}.",
    ],
    "numeric": [
        "Accuracy increased significantly when {clause}.", "Performance improved substantially after {clause}.", "About half of the samples satisfied {clause}.", "Several patients showed that {clause}.", "A large number of cases indicated that {clause}.",
        "The error rate was approximately high after {clause}.", "Results improved nearly 20% although the base rate is unspecified when {clause}.",
    ],
    "publication": [
        "As shown in Figure 3, {clause}.", "Standard procedures were used while {clause}.", "The analysis was carefully performed and {clause}.", "Results were promising when {clause}.", "Further details are provided in the appendix; briefly, {clause}.",
        "See Table 2. {clause}.", "Due to space constraints, we note that {clause}.", "The proposed method works well when {clause}.",
    ],
}
UNSEEN_TEMPLATES = {
    "novelty": [
        "As far as we are aware, {clause}.", "This represents the first attempt in the literature where {clause}.", "Ours is an entirely new framework under which {clause}.", "Prior studies have never considered the scenario in which {clause}.",
        "We break new ground by demonstrating that {clause}.", "The originality of this study lies in the fact that {clause}.", "Nothing comparable has appeared in earlier research showing that {clause}.",
    ],
    "numeric": [
        "A considerable fraction of the trials revealed that {clause}.", "The gains were sizeable once {clause}.", "Roughly a third of participants reported that {clause}.", "Outcomes rose markedly whenever {clause}.", "In the vast majority of runs, {clause}.",
        "Error dropped noticeably after {clause}.", "Close to ninety percent of subjects found that {clause}.",
    ],
    "publication": [
        "The reader is referred to Table 4 for specifics; in short, {clause}.", "Conventional protocols were adopted throughout, and {clause}.", "Owing to page limits we defer the derivation, noting only that {clause}.", "Figure 7 depicts the outcome, namely that {clause}.",
        "All measurements were rigorously carried out and {clause}.", "The findings were encouraging in that {clause}.", "Full particulars appear in the supplementary material; briefly, {clause}.",
    ],
}
CLAUSE_WORDS, LEAST_WORDS, MOST_WORDS, ROUNDS = 28, 8, 65, 3


def clause(sentence) -> Column:
    """A sentence as a clause: without full stops at its end, its first letter small unless the word begins with capitals, 28 words at most."""
    begin = lambda s: F.substring(s, 1, 2)
    small = lambda s: F.when(F.upper(begin(s)) == begin(s), s).otherwise(F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s))))
    first = lambda s: T.let(F.split(s, r"\s+"), lambda w: F.when(F.size(w) > CLAUSE_WORDS, F.array_join(F.slice(w, 1, CLAUSE_WORDS), " ")).otherwise(s))
    return T.let(T.let(F.regexp_replace(F.trim(sentence), r"\.+$", ""), small), first)


def fit_sentence(text: str = "text") -> Column:
    """Of 8 to 65 words, one of them with three letters."""
    return T.word_count(text).between(LEAST_WORDS, MOST_WORDS) & F.col(text).rlike("[A-Za-z]{3,}")


def text_key(text: str = "text") -> Column:
    return F.md5(F.lower(text))


def open_sentences(sentences: DataFrame) -> DataFrame:
    """(row_id, text, label, hard, key): sentences without citation markers, fit for a corpus, weakly labelled; the first of equal texts.

    Texts are shuffled once, to meet their equals, and written once; keys are made as
    they are read, as they are no shorter when packed.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", corpus.MARKED, ""), r"\s+", " "))
    rows = T.each(sentences, F.array(clean), F.concat_ws("-", "doc_id", "sentence_index").alias("row_id"), name="text").filter(fit_sentence())
    # half the bytes of its digits
    firsts = rows.groupBy(F.unhex(text_key()).alias("key")).agg(F.min(F.struct("row_id", "text")).alias("f")).select("f.*")
    kept = stored(firsts.withColumn("label", corpus.weak_label()).withColumn("hard", near_a_label()), "sentences")
    return kept.withColumn("key", F.coalesce(text_key(), F.lit("")))


#: Rows that may be sent to every task, and how many are drawn for each that is wanted, so that enough of them are fresh.
FEW, DRAWN = 20_000, 20


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, n at most, for a join with many: to every task if they are few, else by a sort of both."""
    return F.broadcast(rows) if n <= FEW else rows.hint("merge")


def _named(pool: DataFrame, labels: list[str], *keep) -> DataFrame:
    """(row_id, base, label, r, and the columns ``keep``): each row of the pool with each label and each round."""
    tries = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(r).alias("r")) for label in labels for r in range(ROUNDS)])
    each = pool.select(F.col("row_id").alias("base"), *keep, F.explode(tries).alias("x")).select("*", "x.*").drop("x")
    return each.withColumn("row_id", F.concat_ws("/", "label", "base", "r"))


def _made(pool: DataFrame, templates: dict[str, list[str]], seed: str) -> DataFrame:
    """(row_id, label, text, mark): the clause of each sentence of the pool in up to three templates of each label, chosen by a hash; ``mark`` is a short hash of the text, case aside."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "label", "base")), 1, 8), 16, 10).cast("long") + F.col("r")
    template = F.lit(None).cast("string")
    for label, ts in templates.items():
        template = F.when(F.col("label") == label, F.get(F.array(*[F.lit(t) for t in ts]), (drawn % len(ts)).cast("int"))).otherwise(template)
    # an expression beside an explode is made for each of its rows, so the clause comes before
    rows = _named(pool.select("row_id", clause("text").alias("clause")), list(templates), "clause")
    # each text comes as a row of its own array, so that no test of a join makes it again
    made = T.each(rows, F.array(F.replace(template, F.lit("{clause}"), F.col("clause"))), "row_id", "label", name="text")
    return made.withColumn("mark", F.xxhash64(F.lower("text")))


def synthesized(pool: DataFrame, seen: DataFrame, need: dict[str, int], templates: dict[str, list[str]], seed: str) -> DataFrame:
    """(row_id, text, label, key): sentences made from the clauses of ``pool`` (row_id, text), exactly as many of each label as ``need`` says, if the pool is large enough.

    Each sentence of the pool meets each label that lacks rows with up to three
    templates, chosen by a hash. What is fit, is not among ``seen`` (key) and comes
    first of equal texts is drawn in a seeded order. The beginning of that order is
    drawn first, with all that has the same texts; where too little of it is fresh,
    more is, and all in the end: what is made is neither shuffled nor written
    otherwise. The pool is read a few times, so it should be a written table. Only
    labels short of rows and their templates, a table of a few rows, are literals of
    the plan.
    """
    short = {label: n for label, n in need.items() if n > 0}
    if not short:
        return pool.select("row_id", "text", F.lit("").alias("label"), F.lit("").alias("key")).limit(0)
    templates = {label: templates[label] for label in short}
    each = pool.count() * ROUNDS
    share = DRAWN * max(short.values()) / max(each, 1)
    while True:
        whole = share >= 1
        begins = F.lit(True) if whole else corpus.order(F.lit(seed), "row_id") < F.lit(f"{int(share * 16**8):08x}")
        n = each * len(short) * min(1, 2 * share)
        made = _made(pool, templates, seed)
        if not whole:
            bases = _named(pool, list(short), "text").filter(begins).select(F.col("base").alias("row_id"), "text").distinct()
            marks = _made(bases, templates, seed).filter(begins).select("mark").distinct()
            made = made.join(_sent(marks, n), "mark", "left_semi")
        made = stored(made.filter(fit_sentence()).drop("mark"), "clauses").withColumn("key", F.coalesce(text_key(), F.lit("")))
        fresh = corpus.first_of_each(made, "key", "row_id").filter(begins)
        known = seen.select("key").join(_sent(fresh.select("key"), n), "key", "left_semi").distinct()
        fresh = fresh.join(known.hint("merge"), "key", "left_anti").select("row_id", "text", "label", "key")
        out = cuts.least(fresh, short, "label", seeded(seed, "row_id"))
        have = {} if whole else bucket_counts(out, ["label"])
        if whole or all(have.get((label,), 0) >= k for label, k in short.items()):
            return out
        share *= 16


def near_a_label() -> Column:
    """Rows without a label whose numbers are precise, or whose novelty is shown."""
    return (F.col("label") == "none") & (F.col("text").rlike(claims.PRECISE_NUMBER) | F.col("text").rlike(T.words_at(claims.NOVELTY_SHOWN)))


def quality_corpus(rows: DataFrame, want: dict[str, int], hard: int, seed: str = "8") -> DataFrame:
    """(row_id, text, label, key, origin): weakly labelled sentences drawn to a number for each label.

    ``rows``: as from ``open_sentences``. Of the label ``none`` up to ``hard`` rows are
    hard negatives, whose wording is near a label but proved; other labels that lack
    rows are filled up from templates and clauses of ``none``.
    """
    have = bucket_counts(rows, ["label", "hard"])
    n_hard = min(have.get(("none", True), 0), hard, want.get("none", 0))
    natural = {(label, False): n for label, n in want.items() if label != "none"}
    kept = quota(rows, {**natural, ("none", True): n_hard, ("none", False): want.get("none", 0) - n_hard}, ["label", "hard"], seed, "row_id", written=True)
    need = {label: n - have.get((label, False), 0) for label, n in want.items() if label != "none"}
    made = synthesized(rows.filter("label = 'none'"), rows, need, TEMPLATES, f"{seed}t")
    named = kept.withColumn("origin", F.when(F.col("hard"), "hard_negative").otherwise("natural")).drop("hard")
    return named.select("row_id", "text", "label", "key", "origin").unionByName(made.withColumn("origin", F.lit("template")))


def hard_evaluation(rows: DataFrame, trained: DataFrame, natural: int, made: int, hard: int, none: int, seed: str = "14") -> DataFrame:
    """(row_id, text, label, key, origin): sentences that ``trained`` (key) has not, templates that it was not made with, hard negatives and clean sentences, so many of each."""
    fresh = rows.join(_sent(trained.select("key").distinct(), trained.count()), "key", "left_anti")
    labels = list(UNSEEN_TEMPLATES)
    kept = quota(fresh, {**{(c, False): natural for c in labels}, ("none", True): hard, ("none", False): none}, ["label", "hard"], seed, "row_id", written=True)
    origin = F.when(F.col("hard"), "hard_negative").when(F.col("label") == "none", "natural_none").otherwise("natural")
    new = synthesized(fresh.filter("label = 'none'"), rows.select("key").unionByName(trained.select("key")), dict.fromkeys(labels, made), UNSEEN_TEMPLATES, f"{seed}t")
    return kept.withColumn("origin", origin).select("row_id", "text", "label", "key", "origin").unionByName(new.withColumn("origin", F.lit("hard_synth")))


# How a report's passage is put to a rewriter, and what is filled in.
REPORT_FRAME = "similarity report flagged this passage (~{pct}% match; source: {src}). Restate in your own words; keep technical terms and any citation markers: "
AI_FRAME = "AI writing report flagged this passage (high machine-like confidence). Revise for specificity, varied rhythm, and author voice; keep citation markers: "
SHARES = [2, 3, 4, 5, 6, 8, 12]
CUES = ["indexed publication", "internet source", "prior work in reference list", "unidentified repository match"]


def drawn(seed: str, key: str, of: int) -> Column:
    """A number below ``of`` by a hash of seed and key."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), 1, 8), 16, 10).cast("long") % of).cast("int")


def unframed(text) -> Column:
    """A passage without the frame of a report before it."""
    t = T.col(text)
    frame = t.rlike("^(?:similarity|AI writing) report flagged") & F.contains(t, F.lit(": "))
    begins = F.regexp_replace(t, r"(?s)^similarity report flagged this passage \(~\d+% match; source: [^)]*\)\. [^:]*: |^AI writing report flagged this passage [^:]*: ", "")
    return F.when(frame, begins).otherwise(t)


def framed(rows: DataFrame, seed: str) -> DataFrame:
    """Pairs (id, input, target, ...) as a similarity report or one of machine prose has them, chosen by a hash, as are share and source; short pairs give none."""
    similar = F.replace(F.replace(F.lit(REPORT_FRAME), F.lit("{pct}"), F.get(F.array(*[F.lit(x) for x in SHARES]), drawn(f"{seed}p", "id", len(SHARES))).cast("string")), F.lit("{src}"), F.get(F.array(*[F.lit(x) for x in CUES]), drawn(f"{seed}s", "id", len(CUES))))
    frame = F.when(drawn(f"{seed}t", "id", 2) == 0, similar).otherwise(F.lit(AI_FRAME))
    long = (F.length("input") >= 40) & (F.length("target") >= 40)
    return rows.filter(long).withColumns({"input": F.concat(frame, "input"), "id": F.concat("id", F.lit("/report"))})


def pair_corpus(pairs: DataFrame, most: int, seed: str) -> DataFrame:
    """(id, task, split, wrapped, input, target): pairs (pair_id, a, b) in both directions, the first of those whose input begins alike, at most so many of a task in a seeded order, split by hash; and each again in a report's frame."""
    rows = corpus.pair_rows(pairs).withColumns({"id": F.concat_ws("/", "pair_id", "task"), "input": unframed("input")}).withColumn("key", corpus.key_prefix("input", 200))
    rows = corpus.first_of_each(rows, "key", "id")
    rows = quota(rows, {("forward",): most, ("backward",): most}, ["task"], seed, "id").withColumn("split", corpus.split_name("id"))
    rows = rows.select("id", "task", "split", "input", "target")
    return rows.withColumn("wrapped", F.lit(False)).unionByName(framed(rows, seed).withColumn("wrapped", F.lit(True)))


def survival(before, after) -> Column:
    """The share of protected tokens that a rewrite keeps; 1 where there are none. The tokens are looked for once."""
    lost = lambda tokens: F.size(F.filter(tokens, lambda x: ~F.contains(T.col(after), x)))
    return T.let(edits.protected_tokens(before), lambda tokens: F.when(F.size(tokens) == 0, 1.0).otherwise(1.0 - lost(tokens) / F.size(tokens)))


def surviving(rows: DataFrame, before: str, after: str, least: float) -> DataFrame:
    """Rows with ``kept``, the share of protected tokens that a rewrite keeps, if that is enough.

    A share comes as a row of its own array: a filter on it stays above, and the planner neither
    works it out a second time nor moves it ahead of the dealing out of rows to the cores.
    """
    return T.each(rows, F.array(F.round(survival(before, after), 6)), *rows.columns, name="kept").filter(F.col("kept") >= least)


def class_thresholds(rows: DataFrame, classes: list[str], grid: list[float], target: float = 0.9) -> DataFrame:
    """(class, threshold, precision, recall): for each class the threshold of greatest recall with the target precision, else of greatest precision (then recall); the lower of equals.

    rows: (gold, a score column for each class). A row counts for a class only if
    its score is the greatest of all classes.
    """
    scores = F.array(*[F.col(c) for c in classes])
    each = T.each(rows.withColumn("_max", F.array_max(scores)), F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("score")) for c in classes]), "gold", "_max").select("gold", "_max", "x.*")
    each = each.select("class", (F.col("gold") == F.col("class")).cast("int").alias("label"), F.when(F.col("score") == F.col("_max"), F.col("score")).otherwise(F.lit(-1.0)).alias("score"))
    return evaluate.chosen(evaluate.sweep(each, grid, "class"), target, "class").select("class", "threshold", "precision", "recall")


def bleu(hypothesis: str, reference: str) -> float:
    """BLEU with up to four words; 0 under four words or where a precision is 0."""
    h, r = hypothesis.lower().split(), reference.lower().split()
    if min(len(h), len(r)) < 4:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        a, b = (Counter(zip(*[x[k:] for k in range(n)], strict=False)) for x in (h, r))
        both = sum((a & b).values())
        if not both:
            return 0.0
        logs += math.log(both / (len(h) - n + 1)) / 4
    return math.exp(logs) * (1.0 if len(h) >= len(r) else math.exp(1 - len(r) / len(h)))


def rouge_l(hypothesis: str, reference: str) -> float:
    """F1 of the longest common subsequence of words.

    Its length by bit vectors: a bit for each word of the reference, all of them
    moved on at once for each word of the hypothesis.
    """
    h, r = hypothesis.lower().split(), reference.lower().split()
    if not h or not r:
        return 0.0
    places: dict[str, int] = {}
    for k, w in enumerate(r):
        places[w] = places.get(w, 0) | 1 << k
    every = (1 << len(r)) - 1
    open_ = every
    for w in h:
        met = open_ & places.get(w, 0)
        if met:
            open_ = (open_ + met | open_ - met) & every
    return 2 * (len(r) - open_.bit_count()) / (len(h) + len(r))


@pandas_udf(DoubleType())
def bleu_column(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([bleu(a or "", b or "") for a, b in zip(hypothesis, reference, strict=True)], dtype=float)


@pandas_udf(DoubleType())
def rouge_column(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(a or "", b or "") for a, b in zip(hypothesis, reference, strict=True)], dtype=float)


def rewrite_report(rows: DataFrame, baseline: DataFrame, margin: float = -0.02) -> DataFrame:
    """(task, n, entity_fidelity, bleu, rouge_l, and the difference of each to the stored baseline, holds): means over all rewrites (task, source, hypothesis, target) of a task.

    ``holds``: no mean is below its baseline by more than the margin; baseline (task, and the three means), one row a task.
    """
    scored = rows.select("task", survival("source", "hypothesis").alias("entity_fidelity"), bleu_column("hypothesis", "target").alias("bleu"), rouge_column("hypothesis", "target").alias("rouge_l"))
    names = ["entity_fidelity", "bleu", "rouge_l"]
    means = scored.groupBy("task").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names])
    both = means.join(baseline.select("task", *[F.col(c).alias(f"b_{c}") for c in names]).hint("merge"), "task", "left")
    deltas = [(F.col(c) - F.col(f"b_{c}")).alias(f"d_{c}") for c in names]
    out = both.select("task", "n", *names, *deltas)
    holds = F.coalesce(F.least(*[F.col(f"d_{c}") for c in names]) >= margin, F.lit(True))
    return out.withColumn("holds", holds)


def raw_ranges(rows: DataFrame, index: str, passage: str) -> DataFrame:
    """Adds raw_start and raw_end: where a passage stands in a text, given its ``functions.text.match_index``, if both are normalised, with the marks after it that are no letters, digits or blanks; -1, -1 if it doesn't."""
    rows = rows.withColumn("_r", T.raw_place(index, passage))
    after = F.regexp_extract(F.substring(F.col(f"{index}.t"), F.col("_r.e") + 1, F.length(F.col(f"{index}.t"))), r"^[^A-Za-z0-9\sﬁﬂﬀ]*", 0)
    return rows.withColumns({"raw_start": F.coalesce("_r.s", F.lit(-1)), "raw_end": F.when(F.col("_r").isNotNull(), F.col("_r.e") + F.length(after)).otherwise(-1)}).drop("_r")


#: Prefixes of an edit's normalised text that are looked for where it is not there in full.
PREFIXES = (120, 80, 48)


def locate_edits(changes: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, edit_id, found_page, matched): the page that an edit (doc_id, edit_id, page, text) stands on: its own, else the one before, else the one after; null if none.

    A page (doc_id, page, text) holds the whole normalised text, or a prefix of
    120, 80 or 48 characters of a longer one; ``matched`` is how many characters.
    """
    near = F.array(*[F.struct((F.col("page") + d).alias("page"), F.lit(k).alias("turn")) for k, d in enumerate((0, -1, 1))])
    wanted = T.each(changes.select("doc_id", "edit_id", "page", T.normalize_match("text").alias("needle")), near, "doc_id", "edit_id", "needle").select("doc_id", "edit_id", "needle", "x.page", "x.turn")
    asked = wanted.groupBy("doc_id", "page").agg(F.collect_list(F.struct("edit_id", "needle", "turn")).alias("asked"))
    # a page is normalised once it is known that an edit is looked up on it
    held = pages.join(asked.hint("merge"), ["doc_id", "page"]).select("doc_id", "page", "asked", T.normalize_match("text").alias("hay"))
    pairs = T.each(held, "asked", "doc_id", "page", "hay").select("doc_id", "page", "hay", "x.*")
    n = F.length("needle")
    size = F.when(F.contains("hay", F.col("needle")) & (n > 0), n)
    for p in PREFIXES:
        size = size.when((n > p) & F.contains("hay", F.substring("needle", 1, p)), p)
    best = pairs.withColumn("size", size).filter("size IS NOT NULL").groupBy("doc_id", "edit_id").agg(F.min(F.struct("turn", "page", "size")).alias("b"))
    return changes.select("doc_id", "edit_id").join(best.hint("merge"), ["doc_id", "edit_id"], "left").select("doc_id", "edit_id", F.col("b.page").alias("found_page"), F.col("b.size").alias("matched"))


def shown_value(value, family) -> Column:
    """A value with its unit, whole numbers without a fraction."""
    plain = F.regexp_replace(F.format_string("%.3f", value.cast("double")), r"\.?0+$", "")
    return F.concat(plain, F.when(family == "percent", "%").otherwise(""))


DECISION = "struct<id:string,keep:boolean,reason:string,confidence:double>"


def decode_decisions(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(payload columns, id, keep, reason, confidence) of a JSON list of decisions: without ``keep`` a finding stays, without confidence it is 0.5; what is no JSON gives no rows."""
    rows = T.each(payloads.withColumn("_j", F.from_json(column, f"array<{DECISION}>")), "_j", *[c for c in payloads.columns if c != column])
    return rows.select(*[c for c in payloads.columns if c != column], F.col("x.id").alias("id"), F.coalesce("x.keep", F.lit(True)).alias("keep"), F.coalesce("x.reason", F.lit("")).alias("reason"), F.coalesce("x.confidence", F.lit(0.5)).alias("confidence"))


def overridden(records: DataFrame, overrides: DataFrame) -> DataFrame:
    """Records with the titles that people entered (doc_id, ref_index, new_title): confidence is then medium and the source edited."""
    rows = records.join(overrides.hint("merge"), ["doc_id", "ref_index"], "left")
    has = F.col("new_title").isNotNull() & (F.trim("new_title") != "")
    return rows.withColumns({"title": F.when(has, F.trim("new_title")).otherwise(F.col("title")), "confidence": F.when(has, "medium").otherwise(F.col("confidence")), "origin": F.when(has, "edited").otherwise("parsed")}).drop("new_title")
