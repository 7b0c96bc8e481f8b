"""The registered search takes the whole vocabulary, on all outer folds and in both generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from colwright.catalog import all_queries
from colwright.plans import search
from colwright.plans.spec import from_json, specs_table


def test_registered_search_proposes_the_whole_vocabulary_in_both_generations(spark, tmp_path, monkeypatch):
    rows = [(i, i % 5, f"s{i % 3}", float(i * 37 % 11)) for i in range(60)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    asked = {}

    def scored(df, specs, *args, **where):
        """A score for the two first names, in place of the fits; a training table is told by its number of rows."""
        best = sorted(s.label for s in specs)[:2]
        asked.setdefault(df.count(), []).append(([s.label for s in specs], [s for s in specs if s.label in best]))
        score = F.when(F.col("feature").isin(best), F.lit(-1.0 / len(asked)))
        listed = specs_table(spark, specs).select("feature", "op", "spec")
        return listed.withColumns({"filter_score": F.lit(0.5), "score": score, "signature": F.when(score.isNotNull(), F.array(score))})

    monkeypatch.setattr(search, "evaluate_round", scored)
    monkeypatch.setattr(search, "hold_out_score", lambda df, specs, target, protocol, outer, fold, *args, **where: spark.createDataFrame([(fold, -1.0)], "outer_fold int, score double"))
    found = all_queries()["feature_search"](spark, str(tmp_path)).collect()

    numeric, categorical = ["c_custkey", "c_nationkey"], ["c_mktsegment"]
    first = search.propose(numeric, categorical, series=True)
    assert len({s.op for s in first}) >= 30
    assert len(asked) == 5  # training tables of outer folds in time order differ in length
    for labels, best in (generations[0] for generations in asked.values()):
        assert labels == [s.label for s in first]
    for generations in asked.values():
        kept = sorted(generations[0][1], key=lambda s: s.label)
        deeper = [s.label for s in search.deepen(kept, numeric, categorical, series=True)]
        assert generations[1][0] == [x for x in deeper if x not in {s.label for s in kept}]
    for j in range(5):
        of_fold = [r for r in found if r["outer_fold"] == j]
        assert {r["generation"] for r in of_fold} == {0, 1}
        assert sum(r["best"] for r in of_fold) == 2
        assert {from_json(r["spec"]).label for r in of_fold if r["generation"] == 0} == {s.label for s in first}
