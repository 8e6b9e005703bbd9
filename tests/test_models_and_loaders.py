from foliant.operators import evaluate
from foliant.plans import loader_queries
from foliant.sources import loaders


def test_text_baseline_ranks_held_out_rows(spark):
    scored = loader_queries.q18_text_baseline(spark, "/root/testdata/sf0.01").filter("split <> 'train'")
    assert evaluate.roc_auc(scored).first().auc > 0.9


def test_models_are_fitted_after_counted_writes(spark, sf, tmp_path):
    loaders.write_splits(spark.createDataFrame([("train", "1", "a")], "split string, label string, text string"), f"{tmp_path}/x", ["train"], ["1"])
    assert loader_queries.q18_text_baseline(spark, sf).count() > 0


def test_ranker_scores_every_row_once(spark):
    rows = loader_queries.q19_finding_ranker(spark, "/root/testdata/sf0.01").cache()
    assert rows.count() == rows.select("row_id").distinct().count() and rows.select("fold").distinct().count() == 5
    assert evaluate.roc_auc(rows).first().auc > 0.7


def test_json_lines_leave_out_what_is_corrupt(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\nnot json\n{"a": 2}\n')
    assert sorted(map(tuple, loaders.json_lines(spark, str(tmp_path), "a long, b string").collect())) == [(1, "x"), (2, None)]


def test_history_replaces_a_run(spark, tmp_path):
    for _ in range(2):
        loaders.append_history(spark.createDataFrame([(1,)], "x long"), str(tmp_path), "r1")
    loaders.append_history(spark.createDataFrame([(2,)], "x long"), str(tmp_path), "r2")
    assert spark.read.json(str(tmp_path)).count() == 2


def test_first_present_column(spark):
    df = spark.createDataFrame([(None, "b"), ("a", "c")], "text string, body string")
    assert [r.t for r in loaders.first_present(df, "t", ["content", "text", "body"]).collect()] == ["b", "a"]
