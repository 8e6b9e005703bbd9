"""Numeric claims and conflicts, reference lists of all shapes, cuts of texts that hold the marks themselves."""

import random

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import numbers, parse


def sentences(spark, *docs):
    rows, out = [], []
    for d, doc in enumerate(docs):
        at = 0
        for i, item in enumerate(doc):
            text, section, page = (item if isinstance(item, tuple) else (item, "Results", 1))
            rows.append((d, i, section, page, at, at + len(text), text))
            at += len(text) + 1
        out.append(" ".join(x[0] if isinstance(x, tuple) else x for x in doc))
    return spark.createDataFrame(rows, "doc_id long, sentence_index int, section string, page int, start_offset int, end_offset int, text string")


def test_conflicts(spark):
    cases = [
        (["We enrolled n = 50 patients in the prospective cohort that is described below.", "Results are reported for the whole cohort of n = 45 patients who came back."], [("sample_size", "count", "50 n", "45 n")]),
        ([("The model achieved an accuracy of 92% on the held-out benchmark.", "Abstract", 1), ("Overall we observe 90% accuracy under the same protocol.", "Results", 2)], [("accuracy", "percent", "92%", "90%")]),
        (["Training accuracy reached 98% on the source.", "Test accuracy was 91% on the target domain."], []),
        (["The baseline network had an F1 of 0.81 on the val part.", "Our proposed model had an F1 of 0.88 on the val part."], []),
        (["We used a sample size of 120 subjects for it.", "Among n = 120 subjects the mean age was 54.2 years."], []),
        (["Precision was 88% on the binary task.", "Recall was 76% on the binary task."], []),
        (["Samples were annealed at a temperature of 25 °C for two hours.", "Annealing used a temperature of 37 °C as stated."], [("temperature", "temperature", "25 C", "37 C")]),
        (["The voltage of 5 V was in the first run.", "The voltage of 5.04 V was in the second run.", "Later the voltage = 5.2 V was seen."], [("voltage", "voltage", "5 V", "5.2 V"), ("voltage", "voltage", "5.04 V", "5.2 V")]),
        (["A learning rate of 64 was set in it.", "A learning rate of 68 was set in it.", "The batch size of 16 was set; batch size of 2000."], [("learning_rate", "generic", "64", "68")]),
        (["The accuracy was 90% in one, whereas the accuracy was 70% in the other.", "In the end the accuracy was 50% for all."], []),
        ([("We saw n = 30 patients here and there.", "References", 1), "We saw n = 40 patients here."], []),
    ]
    claims = numbers.numeric_claims(sentences(spark, *[c for c, _ in cases]))
    got = {}
    for r in numbers.numeric_conflicts(claims).orderBy("doc_id", "a_start", "b_start").collect():
        got.setdefault(r.doc_id, []).append((r.metric, r.family, r.a_shown, r.b_shown))
    assert got == {d: want for d, (_, want) in enumerate(cases) if want}
    assert [r.cross_page for r in numbers.numeric_conflicts(claims).filter("doc_id = 1").collect()] == [True]


def test_overlapping_claims_and_qualifiers(spark):
    rows = sentences(spark, ["At 300 K the accuracy of 92% precision was a mean iou: 0.5 IoU 0.9.", "Before the test the error rate was 3.5% (mAP = 41, at 5 mA), n=7."])
    got = [(r.metric, r.family, r.raw, r.unit, r.qualifiers) for r in numbers.numeric_claims(rows).orderBy("doc_id", "claim_start").collect()]
    assert got == [
        ("temperature", "temperature", "300", "K", []), ("accuracy", "percent", "92", "", []), ("iou", "ratio", "0.5", "", []), ("iou", "ratio", "0.9", "", []),
        ("error_rate", "percent", "3.5", "", ["before", "test"]), ("map", "percent", "41", "", ["test"]), ("current", "current", "5", "mA", ["test"]), ("sample_size", "count", "7", "n", []),
    ]


def test_greedy_choice_is_that_of_all_pairs(spark):
    r = random.Random(4)
    words = ["accuracy of 92% precision", "at 5 V", "n = 40", "temperature of 25 C", "90% accuracy 0.9", "recall 0.5 AUC", "lr 0.001", "and", "at 30 mA", "error rate 3"]
    texts = [" ".join(r.choice(words) for _ in range(12)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = df.select("doc_id", F.concat(*[numbers._hits_of("text", k, i) for i, k in enumerate(numbers.CLAIMS)]).alias("a"), numbers.claimed("text").alias("b")).collect()
    for row in every:
        kept = []
        for h in sorted(row.a):
            if all(h.start >= k.start - k.size or h.start - h.size <= k.start for k in kept):
                kept.append(h)
        assert kept == row.b and kept


def test_whole_text_where_no_sentence_claims(spark):
    text = "References of old. The list gives n = 30 patients in one. And others with n = 44 in the end without a stop " + "x" * 40
    docs = spark.createDataFrame([(1, text), (2, text), (3, "n = 5"), (4, "no number at all in this one, however long it may be made to be by words")], "doc_id long, full_text string")
    have = spark.createDataFrame([(2,)], "doc_id long")
    rows = numbers.whole_text_claims(docs, have).orderBy("claim_start").collect()
    assert [(r.doc_id, r.raw, r.section, r.page) for r in rows] == [(1, "30", "Other", 1), (1, "44", "Other", 1)]
    assert rows[0].text == "The list gives n = 30 patients in one." and rows[1].text.startswith("And others") and all(text[r.claim_start : r.claim_end].endswith(r.raw) for r in rows)


def test_marks_in_the_text(spark):
    text = "One ␞ sentence. Another␛c one! \"Third.\" It ␛ ends ␞. Done"
    got = spark.createDataFrame([(1, text)], "doc_id long, full_text string").select(T.sentence_pieces("full_text").alias("p")).first().p
    assert "".join(got) == text and [x.strip() for x in got] == ["One ␞ sentence.", "Another␛c one!", '"Third."', "It ␛ ends ␞.", "Done"]


def test_offsets_of_long_arrays(spark):
    r = random.Random(2)
    sizes = [[r.randrange(9) for _ in range(n)] for n in (0, 1, 511, 512, 513, 5000)]
    for row, want in zip(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s array<int>").orderBy("i").select(T.running("s").alias("r")).collect(), sizes, strict=True):
        assert row.r == [sum(want[:k]) for k in range(len(want))] if len(want) < 600 else row.r[-1] == sum(want[:-1]) and len(row.r) == len(want)


def test_reference_lists(spark):
    brackets = "Introduction. We study it. References [1] Smith, J. and Lee, K., 2020. Deep learning for images. Nature Medicine, 12(3), p.100. [2] Deng, Z. and Wu, Q., 2026. A suspended transistor. Advanced Materials, 32(38), p.2204781. [3] Kakar, V.K. and Pal, P.K., 2025. Dynamics of it. Nature, 8(1), p.14902."
    dots = "Text. References 1. Smith J (2015) A study of things. Journal, 12. 2. Jones K (2018) Another study. Annals, 7. 14 more. 3. Brown L, an entry."
    loose = "Text. References Smith J (2015) A study of small things, Journal of Things, 12. Short. Jones K (2018) Another study of matters."
    falling = "Text. References [9] Smith J (2015) A study of small things. [4] Jones K (2018) Another study of matters. [2] Brown L, an entry there."
    docs = spark.createDataFrame([(1, brackets), (2, dots), (3, loose), (4, "No list [1] Here"), (5, falling), (6, None)], "doc_id long, full_text string")
    got = {}
    for r in parse.references(docs).orderBy("doc_id", "start_offset").collect():
        got.setdefault(r.doc_id, []).append((r.ref_index, r.raw))
        text = {1: brackets, 2: dots, 3: loose, 5: falling}[r.doc_id]
        assert text[r.start_offset :].lstrip().startswith(r.raw)
    assert [k for k, _ in got[1]] == [1, 2, 3] and got[1][1][1].endswith("p.2204781.")
    assert [k for k, _ in got[2]] == [1, 2, 3] and got[2][1][1] == "2. Jones K (2018) Another study. Annals, 7. 14 more."
    assert got[3] == [(1, "Smith J (2015) A study of small things, Journal of Things, 12."), (2, "Jones K (2018) Another study of matters.")]
    assert got[5][0][0] == 1 and len(got[5]) == 5 - 2  # no sequence: cut after full stops, brackets stay
    assert set(got) == {1, 2, 3, 5}


def test_integrity(spark):
    refs = "References [1] Smith J (2015) A study of small things. [2] Jones K (2018) Another study of matters. [3] Brown L (2004) A third study of stuff."
    texts = [f"It was seen [1, 7] and [7]. {refs}", f"It was seen (Jones et al., 2018). {refs}", f"Nothing is cited. {refs}", "It was seen [4] without a list."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, full_text string")
    got = sorted((r.doc_id, r.kind, r.key) for r in parse.integrity(docs).collect())
    assert got == [(0, "broken_citation", 7), (0, "broken_citation", 7), (0, "orphan_ref", 2), (0, "orphan_ref", 3), (1, "orphan_ref", 1), (1, "orphan_ref", 3)]


def test_tables_are_written_once(spark):
    from foliant.sources.shared import shared_dir, stored_once

    made = []

    def make():
        made.append(1)
        return spark.range(3)

    one, two, other = (stored_once(k, make, spark) for k in ("test:a", "test:a", "test:b"))
    assert len(made) == 2 and one.inputFiles() == two.inputFiles() != other.inputFiles() and two.count() == 3
    assert shared_dir(spark) == shared_dir(spark)


def test_parsed_arrays_are_the_tables(spark):
    docs = spark.createDataFrame([(1, "Abstract We did it [1]. It was so. References [1] Smith J (2015) A study of small things. [2] Jones K (2018) Another study."), (2, "No heading here. None."), (3, ""), (4, None)], "doc_id long, full_text string")
    rows = parse.parsed(docs)
    of = lambda name: sorted((r.doc_id, *r.x) for r in T.each(rows, name, "doc_id").collect())
    assert [(d, t) for d, _, t, *_ in of("sentences")] == [(r.doc_id, r.text) for r in parse.sentences(docs).orderBy("doc_id", "sentence_index").collect()]
    assert of("references") == sorted(map(tuple, parse.references(docs).collect()))
    assert of("sections") == sorted(map(tuple, parse.sections(docs).collect()))
    assert [(d, s, e) for d, s, e, *_ in of("citations")] == sorted((r.doc_id, r.start_offset, r.end_offset) for r in parse.citations(docs).collect())
    assert [(d, s, e) for d, _, s, e in of("pages") if d != 1] == [(2, 0, 22), (3, 0, 0), (4, 0, 0)]
