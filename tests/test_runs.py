"""Populations, batches, logs, reviews, search and streaming."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colwright import storage
from colwright.operators import folds, models
from colwright.plans import batches, population, problem, protocol, review, search
from colwright.plans.spec import spec, specs_from, specs_table, with_features
from colwright.sources import runlog
from colwright.storage import complete_versions
from colwright.streaming import progress


def _greedy(sizes, budget):
    out, batch, fill = [], 0, 0
    for i, s in enumerate(sizes):
        if i and fill + s > budget:
            batch, fill = batch + 1, 0
        fill += s
        out.append(batch)
    return out


def test_transfers_chain_like_single_records():
    rng = np.random.default_rng(0)
    for _ in range(300):
        budget = int(rng.integers(1, 40))
        parts = [rng.integers(1, 50, int(rng.integers(1, 8))) for _ in range(int(rng.integers(1, 6)))]
        chained = batches.block_transfer(parts[0], budget)
        for part in parts[1:]:
            chained = chained.then(batches.block_transfer(part, budget))
        for fill in range(budget + 1):
            want, started = fill, 0
            for size in np.concatenate(parts):
                if want + size > budget:
                    want, started = 0, started + 1
                want += size
            got, more = chained.at(np.array([fill]))
            assert (got[0], more[0]) == (want, started)


@pytest.mark.parametrize("block_rows", [1, 3, 50, 1000])
def test_batches_match_the_greedy_rule(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    runs = {"a": rng.integers(1, 60, 300), "b": rng.integers(1, 400, 80), "c": np.array([500]), "d": np.ones(40, int)}
    rows = [(run, i, int(s)) for run, sizes in runs.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "run string, i long, size long").repartition(3)
    got = batches.pack_batches(df, ["run"], ["i"], "size", 100, block_rows=block_rows, fan=5).toPandas()
    for run, sizes in runs.items():
        part = got[got.run == run].sort_values("i")
        assert part["batch_id"].tolist() == _greedy(sizes, 100), run


def test_batches_of_known_sizes(spark):
    sizes = [15000, 20000, 10000, 39000, 2000, 50000, 100]
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, size long")
    for block_rows in (2, 100):
        got = batches.pack_batches(df, [], ["i"], "size", 40000, block_rows=block_rows).orderBy("i").toPandas()
        assert got["batch_id"].tolist() == [0, 0, 1, 2, 3, 4, 5]


def test_softmax_and_draws(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], [5, 3]), "id": range(8), "score": rng.normal(size=8)})
    df = population.softmax(spark.createDataFrame(pdf), ["g"], "score", 0.5, "id", "p")
    got = df.orderBy("id").toPandas()
    for _, part in got.groupby("g"):
        want = np.exp(part["score"] / 0.5)
        np.testing.assert_allclose(part["p"], want / want.sum(), rtol=1e-12)
        assert abs(part["p"].sum() - 1) < 1e-12
    drawn = population.weighted_draws(df, ["g"], "id", "p", 4000).filter("g = 'a'").groupBy("id").count().toPandas()
    shares = drawn.set_index("id")["count"] / 4000
    p = got[got.g == "a"].set_index("id")["p"]
    assert (shares.reindex(p.index).fillna(0) - p).abs().max() < 0.03


def test_non_finite_scores_stop_the_softmax(spark):
    df = spark.createDataFrame([("a", 1, float("inf")), ("a", 2, 1.0)], "g string, id int, score double")
    with pytest.raises(Exception, match="finite"):
        population.softmax(df, ["g"], "score", 1.0, "id", "p").collect()


def test_clusters_and_best(spark):
    rows = [(0, 1, 0.5, [0.5]), (0, 2, 0.5, [0.5]), (0, 3, 0.2, [0.2]), (1, 4, None, None), (1, 5, 0.1, [0.1])]
    df = spark.createDataFrame(rows, "island_id int, step long, score double, signature array<double>")
    clusters = {(r["island_id"], r["first_step"]): r["n_programs"] for r in population.clusters(df).collect()}
    assert clusters == {(0, 1): 2, (0, 3): 1, (1, 5): 1}
    best = {r["island_id"]: (r["best_score"], r["best_step"]) for r in population.island_best(df).collect()}
    assert best == {0: (0.5, 1), 1: (0.1, 5)}
    chosen = population.sample_clusters(population.clusters(df), 0.1).collect()
    assert sorted((r["island_id"], r["draw"]) for r in chosen) == [(0, 0), (0, 1), (1, 0)]


def _log_frame(spark, n=40):
    rows = [("r1" if i % 3 else "r2", i % 2, i, 100 + i, f"p{i}", f"x\n  df_output['f{i}'] = {i}\ny", None if i % 7 == 0 else i / 10) for i in range(n)]
    return spark.createDataFrame(rows, runlog.LOG_SCHEMA)


def test_log_round_trip_and_stream(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    df = _log_frame(spark)
    runlog.append_log(df.filter("sample_order < 20"), log)
    state = str(tmp_path / "state")
    progress.write_progress(progress.log_stream(spark, log), out, state).awaitTermination()
    first = {r["run_id"]: r["successes"] for r in progress.read_progress(spark, out).collect()}
    runlog.append_log(df.filter("sample_order >= 20"), log)
    progress.write_progress(progress.log_stream(spark, log), out, state).awaitTermination()
    second = {r["run_id"]: r for r in progress.read_progress(spark, out).collect()}
    back = runlog.read_log(spark, log)
    assert back.count() == 40
    assert back.filter("sample_order = 5").first()["generated_program"] == "  df_output['f5'] = 5"
    assert sum(first.values()) == 17 and sum(r["successes"] for r in second.values()) == 34
    assert second["r1"]["best_score"] == 3.8 and second["r1"]["best_step"] == 38


def test_log_files_do_not_grow_with_the_tasks(spark, tmp_path):
    log, out = tmp_path / "log", tmp_path / "out"
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    runlog.append_log(_log_frame(spark, 400).repartition(16), str(log))
    assert len(list(log.glob("run_id=*/split=*/*.json"))) == 4
    progress.write_progress(progress.log_stream(spark, str(log)), str(out)).awaitTermination()
    assert sum(r["successes"] + r["failures"] for r in progress.read_progress(spark, str(out)).collect()) == 400
    state = out / "_checkpoint" / "state"
    assert any(state.rglob("*.zip")) and not any(state.rglob("*.delta"))
    assert spark.conf.get(name, None) == before


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_keeps_bad_lines_apart_and_counts_repeats_once(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    df = _log_frame(spark, 12)
    place = tmp_path / "log" / "run_id=r1" / "split=0"
    place.mkdir(parents=True)
    bad = ["not json", '{"sample_order": 90, "score": "high"}', '{"score": 5.0}']
    (place / "part-0.json").write_text("\n".join([*bad, '{"sample_order": 91, "score": "NaN"}', "", "not json"]) + "\n")
    assert progress.read_progress(spark, out).count() == 0 and progress.read_malformed(spark, out).count() == 0
    runlog.append_log(df, log)
    progress.write_progress(progress.log_stream(spark, log), out).awaitTermination()
    totals = _rows(progress.read_progress(spark, out))
    assert totals == [("r1", 1.1, 11, 7, 2), ("r2", 0.9, 9, 3, 1)]
    lines = [r[2] for r in _rows(progress.read_malformed(spark, out))]
    assert lines == [bad[0], bad[1], '{"score":5.0,"run_id":"r1","split":0}']

    runlog.append_log(df, log)  # all lines once more, in new files
    (place / "part-1.json").write_text("not json\n" + '{"sample_order": 12, "score": 1.1}\n')
    progress.write_progress(progress.log_stream(spark, log, files_per_batch=2), out, keep=1).awaitTermination()
    assert _rows(progress.read_progress(spark, out)) == [("r1", 1.1, 11, 8, 2), ("r2", 0.9, 9, 3, 1)]
    assert progress.read_malformed(spark, out).count() == 3
    assert len(complete_versions(spark, f"{out}/totals")) == 1
    with pytest.raises(ValueError, match="do not belong"):
        progress.write_progress(progress.log_stream(spark, log), out, str(tmp_path / "other"))


def test_replayed_batch_and_half_written_version(spark, tmp_path):
    """A version without its end mark is not read and is written again; a complete one is left as it is."""
    log, out, state = str(tmp_path / "log"), str(tmp_path / "out"), tmp_path / "state"
    df = _log_frame(spark, 12)
    runlog.append_log(df.filter("sample_order < 6"), log)
    progress.write_progress(progress.log_stream(spark, log), out, str(state)).awaitTermination()
    first = _rows(progress.read_progress(spark, out))
    runlog.append_log(df.filter("sample_order >= 6"), log)
    progress.write_progress(progress.log_stream(spark, log), out, str(state)).awaitTermination()
    second = _rows(progress.read_progress(spark, out))
    assert first != second and sum(r[3] + r[4] for r in second) == 12
    versions = complete_versions(spark, f"{out}/totals")
    # the batch with the second half of the log; one without data may follow, to clean the state up
    number = next(v for v in versions if _rows(progress._read_version(spark, out, v)) == second)

    def stop_inside_the_batch():
        """The stream's own files as they are when the driver is lost while the batch runs."""
        for folder, first_lost in (("commits", number), ("offsets", number + 1)):
            for p in (state / folder).iterdir():
                if int(p.name.strip(".").removesuffix(".crc")) >= first_lost:
                    p.unlink()

    def written():
        return sorted((str(p), p.stat().st_mtime_ns) for p in Path(out, "totals", f"version={number}").iterdir())

    stop_inside_the_batch()
    before = written()
    progress.write_progress(progress.log_stream(spark, log), out, str(state)).awaitTermination()
    assert written() == before and _rows(progress.read_progress(spark, out)) == second

    stop_inside_the_batch()
    for v in versions:
        if v >= number:
            Path(out, "totals", f"version={v}", "_SUCCESS").unlink()
    assert _rows(progress.read_progress(spark, out)) == first
    progress.write_progress(progress.log_stream(spark, log), out, str(state)).awaitTermination()
    assert _rows(progress.read_progress(spark, out)) == second


def test_new_candidates_keep_the_first(spark):
    df = _log_frame(spark, 6)
    doubled = df.unionByName(df.withColumn("timestamp", F.col("timestamp") + 50).withColumn("score", F.lit(9.0)))
    fresh = runlog.new_candidates(doubled, df.filter("sample_order < 2"))
    assert sorted((r["sample_order"], r["timestamp"]) for r in fresh.collect()) == [(i, 100 + i) for i in range(2, 6)]


def test_reviews(spark):
    text = '{"review": [{"program_index": 1, "classification": "No impact"}, {"program_index": 9}]}'
    df = spark.createDataFrame([("r", text), ("r", '[{"program_index": 2, "feature_name": "f"}]'), ("r", "bad")], "run_id string, t string")
    candidates = spark.createDataFrame([("r", 1, 0.5), ("r", 2, None)], "run_id string, program_index long, score double")
    rows = {r["program_index"]: r for r in review.review_table(review.parse_reviews(df, "t", "run_id"), candidates).collect()}
    assert rows[1]["score"] == 0.5 and rows[2]["score"] is None and rows[9]["score"] == 0.0
    assert rows[9]["feature_name"] == "Unknown" and rows[9]["classification"] == "N/A" and rows[1]["classification"] == "No impact"


def test_rules_on_specs(spark):
    columns = spark.createDataFrame(
        [("price", "continuous", "usd", False), ("age", "continuous", "years", False), ("zip", "nominal", None, True)],
        "name string, kind string, unit string, is_id boolean",
    )
    made = [
        spec("multiply", "price", "age", name="ok"),
        spec("multiply", "price", "zip", name="magnitude"),
        spec("subtract", "price", "age", name="units"),
        spec("log", "zip", name="type"),
        spec("group_mean", "zip", "price", name="leak"),
        spec("linear", "price", factor=2.0, name="copy"),
        spec("rolling_mean", "price", n=3, name="past"),
    ]
    got = {r["feature"]: r["classification"] for r in review.review_specs(specs_table(spark, made), columns).collect()}
    assert got == {
        "ok": review.MAKES_SENSE,
        "past": review.MAKES_SENSE,
        "magnitude": review.NO_SENSE,
        "units": review.NO_SENSE,
        "type": review.NO_SENSE,
        "leak": review.NO_SENSE,
        "copy": review.NO_IMPACT,
    }
    fitted = review.review_specs(specs_table(spark, made, fit=True), columns)
    assert fitted.filter("feature = 'leak'").first()["classification"] == review.MAKES_SENSE


def _product(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(400), "a": rng.normal(size=400), "b": rng.normal(size=400)})
    pdf["y"] = pdf["a"] * pdf["b"]
    return spark.createDataFrame(pdf)


SHUFFLED = protocol.Protocol("regression", "rmse", "shuffled", "shuffled", outer_folds=2, inner_folds=2)


def test_search_finds_the_product(spark):
    ask = lambda: search.search(_product(spark), ["a", "b"], [], "y", SHUFFLED, ["id"], keep=1, rounds=3).collect()
    found, again = ask(), ask()
    assert sorted(map(str, found)) == sorted(map(str, again))
    proposed = {s.label for s in search.propose(["a", "b"])}
    for j in range(2):
        rows = [r for r in found if r["outer_fold"] == j]
        assert {r["feature"] for r in rows} == proposed and len(rows) == len(proposed)
        best = [r for r in rows if r["best"]]
        assert [r["feature"] for r in best] == ["multiply(a, b)"]
        assert all(np.isfinite([r["filter_score"], r["score"], r["hold_out"]]).all() and r["cluster"] == 1 for r in best)
        assert all(r["score"] is None for r in rows if not r["best"])


def test_best_of_all_generations_is_held_out(spark):
    df = _product(spark)
    found = search.search(df, ["a", "b"], [], "y", SHUFFLED, ["id"], generations=2, keep=1, rounds=3, operators=("multiply", "absolute")).filter("best").collect()
    # nothing on top of the product beats the product
    assert {(r["generation"], r["feature"]) for r in found} == {(0, "multiply(a, b)")}


def test_search_finds_a_planted_lag(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"t": range(600), "x": rng.normal(size=600)})
    pdf["y"] = pdf["x"].shift(3).fillna(0.0)
    series = protocol.Protocol("regression", "nrmse", "time", "time", outer_folds=1, inner_folds=2)
    found = search.search(spark.createDataFrame(pdf), ["x"], [], "y", series, ["t"], ["t"], keep=1, rounds=3)
    assert [r["feature"] for r in found.filter("best").collect()] == ["lag(x, n=3)"]


def test_specs_survive_a_table(spark):
    made = search.propose(["a", "b"], ["c", "d"], series=True) + [spec("recode", "c", mapping=(("x", 1), ("y", 2)), default=0, name="r")]
    back = specs_from(specs_table(spark, made))
    assert [s.key for s in back] == [s.key for s in made] and [s.label for s in back] == [s.label for s in made]


def test_shared_folder_comes_from_the_session(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_malformed_log_lines_stop_the_job(spark, tmp_path):
    folder = tmp_path / "run_id=r" / "split=0"
    folder.mkdir(parents=True)
    good = '{"sample_order": 1, "timestamp": 2, "prompt_id": "p", "generated_program": "x", "score": 0.5}'
    (folder / "a.json").write_text("\n".join([good, "", "{broken", good.replace("0.5", '"high"'), '{"score": 1.0}']) + "\n")
    with pytest.raises(Exception, match="malformed log line"):
        runlog.read_log(spark, str(tmp_path)).collect()
    assert [r["score"] for r in runlog.read_log(spark, str(tmp_path), malformed="skip").collect()] == [0.5]
    lines = sorted(r["line"] for r in runlog.malformed_lines(spark, str(tmp_path)).collect())
    assert len(lines) == 3 and lines[-1].startswith("{broken") and any('"high"' in x for x in lines)


def test_plain_logs_of_one_name_are_numbered_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        line = '{"timestamp": 1, "prompt_id": null, "generated_program": "p", "score": 1.5}\n'
        (tmp_path / folder / "run_split_1_17.jsonl").write_text("\t\n" + line * 2)
    rows = runlog.read_plain_logs(spark, f"{tmp_path}/*").collect()
    assert sorted(r["sample_order"] for r in rows) == [1, 1, 2, 2]


def test_plain_logs_are_numbered_by_line(spark, tmp_path):
    for split in (1, 2):
        lines = [f'{{"timestamp": {i}, "prompt_id": null, "generated_program": "p{i}", "score": {i}.5}}' for i in range(50)]
        lines.insert(3, "")
        (tmp_path / f"run_7_split_{split}_1700000000.jsonl").write_text("\n".join(lines) + "\n")
    rows = runlog.read_plain_logs(spark, str(tmp_path)).orderBy("split", "sample_order").collect()
    assert len(rows) == 100 and {(r["run_id"], r["split"]) for r in rows} == {("run_7", 1), ("run_7", 2)}
    first = [(r["sample_order"], r["generated_program"]) for r in rows[:50]]
    assert first == [(i if i < 3 else i + 1, f"p{i}") for i in range(50)]


def test_problem_from_files_to_scores(spark, tmp_path):
    rng = np.random.default_rng(6)
    n = 200
    pdf = pd.DataFrame(
        {
            "Left-Weight": rng.integers(1, 6, n),
            "Right-Weight": rng.integers(1, 6, n),
            "side": rng.choice(["in", "out", None], n),
        }
    )
    pdf["Class Name"] = np.where((pdf["Left-Weight"] - pdf["Right-Weight"]).abs() > 1, "tilted", "even")
    pdf.to_csv(tmp_path / "balance-scale.csv", index=False)
    (tmp_path / "balance-scale-metadata.json").write_text('{"left-weight": "Left weight"}')
    loaded = problem.load_problem(spark, str(tmp_path), "balance-scale")
    assert loaded.task == "classification" and loaded.target == "Class Name"
    ready = problem.base_table(loaded)
    assert ready.table.columns == list(pdf.columns)
    codes = {r["side"] for r in ready.table.select("side").distinct().collect()}
    assert codes == {0, 1, 2}
    table = with_features(ready.table.withColumn("id", F.monotonically_increasing_id()), [loaded.seed])
    folded = folds.stratified_folds(table, "Class Name", ["id"], 4)
    scores = models.cross_validate(folded, ["weight_difference", "side"], "Class Name", "fold", 4, "classification", rounds=2)
    assert [r["score"] for r in scores.collect()] == [1.0] * 4
