"""Generation, features, heads, scoring, incremental runs and the compositions."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cribado import session
from cribado.operators import head, labels
from cribado.operators.features import apply_stages, encoder_features, text_stages, vector_features
from cribado.operators.generate import generate
from cribado.operators.ledger import read_ledger
from cribado.operators.ratings import clean_ratings, parse_ratings, run_summary, training_rows
from cribado.operators.scoring import quantize, score_documents
from cribado.operators.selection import keep_by_score
from cribado.plans.curation import ask, curate, label_report
from cribado.streaming.incremental import process_new_files


def test_generate_keeps_rows_and_reports_failing_ones(spark):
    def echo():
        def predict(prompts):
            if any("malo" in p for p in prompts):
                raise ValueError("no puedo")
            assert len(prompts) <= 3
            return [p.upper() for p in prompts]

        return predict

    values = [(i, "malo" if i % 7 == 3 else None if i % 7 == 5 else f"p{i}") for i in range(40)]
    df = spark.createDataFrame(values, "id bigint, prompt string").repartition(4)
    for partitions in (None, 2):
        out = generate(df, "prompt", echo, batch_size=3, num_partitions=partitions)
        assert out.columns == ["id", "prompt", "response", "error"]
        for row in out.collect():
            if row.id % 7 == 3:
                assert (row.response, row.error) == (None, "ValueError: no puedo")
            elif row.id % 7 == 5:
                assert (row.response, row.error) == (None, "no prompt")
            else:
                assert (row.response, row.error) == (f"P{row.id}", None)
        assert out.count() == 40


def test_generate_refuses_a_model_that_loses_responses(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string").coalesce(1)
    with pytest.raises(Exception, match="1 responses for 2 prompts"):
        generate(df, "prompt", lambda: lambda prompts: ["x"]).collect()


def test_each_prompt_costs_one_call(spark, tmp_path):
    log = str(tmp_path / "calls.txt")

    def counting():
        def predict(prompts):
            with open(log, "a") as out:
                out.writelines(f"{p}\n" for p in prompts)
            return ["PUNTUACIÓN EDUCATIVA: 3"] * len(prompts)

        return predict

    docs = spark.createDataFrame([(i, f"d{i}") for i in range(50)], "id bigint, texto string")
    answers = ask(docs, "texto", "<EJEMPLO>", counting)
    rows = training_rows(clean_ratings(parse_ratings(answers)))
    assert rows.count() == rows.filter("label = 3.0").count() == 50
    assert sorted(open(log).read().split()) == sorted(f"d{i}" for i in range(50))


def test_run_summary_counts(spark):
    rows = [("a", "PUNTUACIÓN EDUCATIVA: 4", None), ("a", "PUNTUACIÓN EDUCATIVA: .5", None), ("a", None, "x"), ("b", "nada", None)]
    df = spark.createDataFrame(rows, "dataset string, response string, error string")
    assert [tuple(r) for r in run_summary(df, "dataset").orderBy("dataset").collect()] == [
        ("a", 3, 2, 1, 2, 1, 1),
        ("b", 1, 1, 0, 0, 0, 0),
    ]


def vectors(spark, n=200, width=5):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, width)).astype("float32")
    y = np.clip(np.round(2.5 + x @ rng.normal(size=width)), 0, 5)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(n)], "id bigint, v array<float>, label double")
    return x.astype("float64"), y, vector_features(df, "v")


def test_head_equals_least_squares(spark):
    x, y, df = vectors(spark)
    model = head.fit_head(df)
    solution, *_ = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)
    assert np.allclose(model.coefficients.toArray(), solution[:-1], atol=1e-6)
    assert model.intercept == pytest.approx(solution[-1], abs=1e-6)


def test_selection_and_round_trip(spark, tmp_path):
    x, y, df = vectors(spark)
    train, test = df.filter("id < 150"), df.filter("id >= 150")
    grid = [head.Candidate(50.0), head.Candidate(0.0), head.Candidate(0.0)]
    chosen = head.select_head(train, test, grid=grid)
    assert [entry["best"] for entry in chosen.leaderboard] == [False, True, False]
    assert chosen.leaderboard[1]["f1_macro"] > chosen.leaderboard[0]["f1_macro"]
    predicted = np.clip(np.rint(np.c_[x, np.ones(len(x))][150:] @ np.linalg.lstsq(np.c_[x, np.ones(len(x))][:150], y[:150], rcond=None)[0]), 0, 5)
    assert chosen.leaderboard[1]["accuracy"] == pytest.approx(np.mean(predicted == y[150:]))
    head.save_model(chosen.model, str(tmp_path / "m"))
    again = head.load_model(str(tmp_path / "m"))
    scores = lambda m: [r.score for r in score_documents(m, df).orderBy("id").collect()]
    assert scores(again) == scores(chosen.model)
    with pytest.raises(ValueError, match="empty"):
        head.select_head(train, test.filter("id < 0"), grid=grid[:1])


def test_text_features_use_the_whole_text(spark):
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[:2999])), (2, "Años-luz, AÑOS_2")], "id int, texto string")
    stages = text_stages("texto", num_features=1 << 16)
    tokens = [r._words for r in stages[0].transform(df).orderBy("id").collect()]
    assert len(tokens[0]) == 3000 and tokens[2] == ["años", "luz", "años_2"]
    fitted = []
    for stage in stages:
        fitted.append(stage.fit(apply_stages(fitted, df)) if hasattr(stage, "fit") else stage)
    rows = [r.features for r in apply_stages(fitted, df).orderBy("id").collect()]
    assert rows[0] != rows[1]
    assert float(rows[0].norm(2)) == pytest.approx(1.0)


def test_caller_encoder(spark):
    def make():
        def predict(texts):
            return np.array([[len(t), t.count("a")] for t in texts], dtype="float32")

        return predict

    df = spark.createDataFrame([("casa",), ("pan",)], "texto string")
    out = encoder_features(df, "texto", make, batch_size=1).select("texto", vector_to_array("features").alias("f"))
    assert {r.texto: list(r.f) for r in out.collect()} == {"casa": [4.0, 2.0], "pan": [3.0, 1.0]}


def test_scoring_keeps_columns_and_does_not_shuffle(spark):
    _, _, df = vectors(spark)
    scored = score_documents(head.fit_head(df), df)
    assert scored.columns == [*df.columns, "score", "int_score"]
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_the_model_runs_once_per_row_under_a_filter(spark):
    docs = spark.createDataFrame([(i, f"texto {i} " * i) for i in range(20)], "id bigint, texto string")
    stages = text_stages("texto", num_features=16)
    labelled = docs.withColumn("label", F.col("id") % 6 * 1.0)
    chosen = head.select_head(labelled, labelled, stages, [head.Candidate(0.1)])
    kept = keep_by_score(score_documents(chosen.model, docs), 2)
    filters = [line for line in kept._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter" in line]
    assert filters and not any("UDF" in line for line in filters)


def test_incremental_runs_equal_the_batch(spark, tmp_path):
    source, output, checkpoint = (str(tmp_path / name) for name in ("in", "out", "progress"))
    _, _, df = vectors(spark, n=90)
    rows = df.select("id", "v", "label")
    model = head.fit_head(df)
    rows.filter("id < 80").repartition(3).write.parquet(source)

    def run():
        process_new_files(
            spark, source, rows.schema,
            lambda part: score_documents(model, vector_features(part, "v")).drop("features"),
            output, checkpoint, partition_by=["int_score"], max_files_per_batch=2,
        )
        return spark.read.parquet(output).count()

    assert run() == 80
    assert run() == 80
    rows.filter("id >= 80").write.mode("append").parquet(source)
    assert run() == 90
    batch = score_documents(model, df).select("id", "score", "int_score")
    stream = spark.read.parquet(output).select("id", "score", "int_score")
    assert sorted(stream.collect()) == sorted(batch.collect())


def test_generation_resumes_by_file(spark, tmp_path):
    source, output, checkpoint = (str(tmp_path / name) for name in ("in", "out", "progress"))
    log = str(tmp_path / "calls.txt")

    def counting():
        def predict(prompts):
            with open(log, "a") as out:
                out.writelines(f"{p}\n" for p in prompts)
            return [p.upper() for p in prompts]

        return predict

    docs = spark.createDataFrame([(i, f"d{i}") for i in range(30)], "id bigint, texto string")
    for part in ("id < 20", "id >= 20", "id < 0"):
        docs.filter(part).coalesce(1).write.mode("append").parquet(source)
        process_new_files(spark, source, docs.schema, lambda df: generate(df, "texto", counting), output, checkpoint)
    rows = spark.read.parquet(output).collect()
    assert sorted((r.id, r.response) for r in rows) == [(i, f"D{i}") for i in range(30)]
    assert len(open(log).read().split()) == 30


def test_partitioning_does_not_change_results(spark):
    rows = [(f"d{i % 3}", i, f"DOMINIO: Salud, x{i % 4}\nCASOS DE USO: u{i % 11}") for i in range(120)]
    df = spark.createDataFrame(rows, "dataset string, id bigint, response string")
    reports = [
        sorted(labels.top_tags(labels.tag_counts(labels.parse_labels(df.repartition(n)), "id")).collect()) for n in (1, 3, 16)
    ]
    assert reports[0] == reports[1] == reports[2]


def test_curate_end_to_end(spark):
    def judge():
        return lambda prompts: [f"PUNTUACIÓN EDUCATIVA: {min(p.count('bueno'), 5)}" for p in prompts]

    rows = [(i, "malo " * (i % 13) + "bueno " * (i % 6) + f"tema{i % 17}") for i in range(240)]
    docs = spark.createDataFrame(rows, "id bigint, texto string")
    common = ("id", "texto", "Texto: <EJEMPLO>", judge, text_stages("texto", num_features=64))
    everything = curate(docs, docs.filter("id % 2 = 0"), *common, threshold=0, grid=[head.Candidate(0.01)])
    assert everything.count() == 240
    assert everything.filter(F.col("int_score").between(0, 5)).count() == 240
    kept = curate(docs, docs.filter("id % 2 = 0"), *common, threshold=4, grid=[head.Candidate(0.01)])
    assert 0 < kept.count() < 240 and kept.filter("int_score < 4").count() == 0
    good = everything.withColumn("truth", F.col("id") % 6)
    assert good.select(F.corr("score", "truth")).first()[0] > 0.7


def test_label_report_end_to_end(spark):
    def labeler():
        return lambda prompts: ["DOMINIO: Salud\nCASOS DE USO: " + ("a, b" if "1" in p else "a") for p in prompts]

    docs = spark.createDataFrame([("d", i, f"texto {i}") for i in range(4)], "dataset string, id bigint, texto string")
    rows = label_report(docs, "id", "texto", "<EJEMPLO>", labeler).filter("dataset = 'All-Datasets'")
    assert {(r.kind, r.tag, r.n, r.rank) for r in rows.collect()} == {
        ("domain", "Salud", 4, 1), ("use_case", "a", 4, 1), ("use_case", "b", 1, 2)
    }


def test_quantize_adds_one_column(spark):
    assert quantize(spark.createDataFrame([(2.5,)], "score double")).first()[:] == (2.5, 2)


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get(session.CHECKPOINT_KEY)
    paths = {session.fresh_path(spark, "t") for _ in range(3)}
    assert len(paths) == 3 and all(p.startswith(root) for p in paths)


def test_a_sample_from_a_join_is_answered_in_several_tasks(spark):
    """Adaptive execution puts a small joined sample into one partition; the prompts are dealt out again."""

    def where():
        from pyspark import TaskContext

        return lambda prompts: [str(TaskContext.get().partitionId())] * len(prompts)

    docs = spark.range(400).selectExpr("id", "concat('texto ', id) AS texto")
    sample = docs.join(spark.range(0, 400, 2), "id")
    answers = ask(sample, "texto", "<EJEMPLO>", where, num_partitions=5)
    assert answers.columns == ["id", "response", "error"]  # the text is not stored again
    assert answers.select("response").distinct().count() == 5
    assert ask(sample, "texto", "<EJEMPLO>", where, keep=["id", "texto"]).columns[:2] == ["id", "texto"]


def test_a_broken_run_loses_one_batch_at_most(spark, tmp_path):
    log, broken = str(tmp_path / "calls.txt"), str(tmp_path / "broken")

    def counting():
        def predict(prompts):
            with open(log, "a") as out:
                out.writelines(f"{p}\n" for p in prompts)
            if os.path.exists(broken) and any(int(p[1:].rstrip("x")) % 20 == 17 for p in prompts):
                return []  # fails the task
            if any(p == "d5" for p in prompts) and os.path.exists(log + ".flaky"):
                raise RuntimeError("overloaded")
            return [f"PUNTUACIÓN EDUCATIVA: {len(p)}" for p in prompts]

        return predict

    def run(rows, tasks=2):
        docs = spark.createDataFrame(rows, "id bigint, texto string, response string")
        return ask(docs, "texto", "<EJEMPLO>", counting, tasks, ["id"], str(tmp_path / "out"), batch_size=4)

    rows = [(i, f"d{i}", "x") for i in range(60)]
    open(broken, "w").close()
    with pytest.raises(Exception, match="0 responses"):
        run(rows)
    asked = open(log).read().split()
    os.remove(broken)
    noted = {r.key for r in read_ledger(spark, str(tmp_path / "out")).collect()}
    assert 0 <= len(asked) - len(noted) <= 2 * 4  # a batch a task
    assert {r.id: r.response for r in run(rows).collect()} == {i: f"PUNTUACIÓN EDUCATIVA: {len(t)}" for i, t, _ in rows}
    calls = Counter(open(log).read().split())
    assert set(calls) == {t for _, t, _ in rows} and sum(calls.values()) <= 60 + 2 * 4

    changed = [(i, t + "x" if i == 7 else t, r) for i, t, r in rows[:50]] + [(100, None, "x")]
    before = len(open(log).read().split())
    found = {r.id: (r.response, r.error) for r in run(changed).collect()}
    assert open(log).read().split()[before:] == ["d7x"]  # no other row is asked, the removed ones are gone
    assert len(found) == 51 and found[7][0].endswith("3") and found[100] == (None, "no prompt")

    open(log + ".flaky", "w").close()
    other = [(i + 1000, t, r) for i, t, r in rows[:8]]
    assert [r.error for r in run(other, 1).collect() if r.id == 1005] == ["RuntimeError: overloaded"]
    os.remove(log + ".flaky")
    before = len(open(log).read().split())
    assert all(r.error is None for r in run(other, 1).collect())
    assert open(log).read().split()[before:] == ["d5"]


def test_a_fit_that_does_not_converge_warns(spark):
    rng = np.random.default_rng(0)
    rows = [(float(v @ [1, 2, 3]), v.tolist()) for v in rng.normal(size=(80, 3))]
    df = spark.createDataFrame(rows, "label double, v array<double>")
    with pytest.warns(RuntimeWarning, match="not converged"):
        head.fit_head(vector_features(df, "v"), head.Candidate(0.1, elastic_net=0.5, max_iter=1))
