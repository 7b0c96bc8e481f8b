"""Metrics, feature scores, boosted trees and the search."""

from __future__ import annotations

from pyspark.sql import functions as F

from colwright.catalog.base import Book, table
from colwright.operators import folds, groups, metrics, models
from colwright.plans import protocol, search
from colwright.plans.spec import spec

book = Book()

_FOLDS = 4
_FOLD_SQL = """f AS (SELECT event_id, event_type, value,
  ((row_number() OVER (ORDER BY md5('42~' || event_id)) - 1) % 4)::INTEGER AS fold FROM events),
  p AS (SELECT k.fold, event_type, avg(value) AS prediction FROM f, range(4) AS k(fold) WHERE f.fold <> k.fold
    GROUP BY 1, 2),
  s AS (SELECT f.fold, value, prediction FROM f JOIN p ON f.fold = p.fold AND f.event_type = p.event_type)"""


def _folded(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "value")
    return folds.shuffled_folds(df, ["event_id"], _FOLDS)


def _group_mean_predictions(df):
    """Each fold's rows predicted by the mean of their event type over the other folds."""
    return groups.with_out_of_fold_mean(df, ["event_type"], "value", "fold", "prediction")


@book.query(
    "accuracy",
    """SELECT lang, round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END), 6) AS score
       FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
)
def _accuracy(spark, sf):
    labels = table(spark, sf, "labels").withColumn("predicted", 1 - F.col("toxic"))
    rows = labels.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    scores = metrics.fold_scores(rows, "accuracy", "quality", "predicted", ["lang"])
    return scores.select("lang", F.round("score", 6).alias("score"))


@book.query(
    "negative_rmse",
    f"""WITH {_FOLD_SQL} SELECT fold, round(-sqrt(avg((value - prediction) * (value - prediction))), 6) AS score
       FROM s GROUP BY 1""",
)
def _rmse(spark, sf):
    predicted = _group_mean_predictions(_folded(spark, sf))
    scores = metrics.fold_scores(predicted, "rmse", "value", "prediction", ["fold"])
    return scores.select("fold", F.round("score", 6).alias("score"))


_NRMSE_SQL = f"""WITH {_FOLD_SQL}, d AS (SELECT k.fold, stddev_pop(value) AS spread FROM f, range(4) AS k(fold)
      WHERE f.fold <> k.fold GROUP BY 1),
    r AS (SELECT s.fold, -sqrt(avg((value - prediction) * (value - prediction))) / any_value(spread) AS score
      FROM s JOIN d ON s.fold = d.fold GROUP BY 1)"""


@book.query("negative_relative_rmse", f"{_NRMSE_SQL} SELECT fold, round(score, 6) AS score FROM r")
def _nrmse(spark, sf):
    df = _folded(spark, sf)
    spread = metrics.train_spread(df, "value", "fold", _FOLDS)
    scores = metrics.fold_scores(
        _group_mean_predictions(df), "nrmse", "value", "prediction", ["fold"], spread
    )
    return scores.select("fold", F.round("score", 6).alias("score"))


@book.query(
    "mean_fold_score",
    f"{_NRMSE_SQL} SELECT 'group mean' AS candidate, round(avg(score), 6) AS score FROM r",
)
def _mean(spark, sf):
    df = _folded(spark, sf)
    spread = metrics.train_spread(df, "value", "fold", _FOLDS)
    scores = metrics.fold_scores(_group_mean_predictions(df), "nrmse", "value", "prediction", ["fold"], spread)
    mean = metrics.mean_scores(scores.withColumn("candidate", F.lit("group mean")), ["candidate"])
    return mean.select("candidate", F.round("score", 6).alias("score"))


@book.query(
    "train_spread_ordered",
    """WITH t AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n
         FROM events),
       f AS (SELECT value, CASE WHEN i < n - 4 * (n // 5) THEN -1 ELSE (i - (n - 4 * (n // 5))) // (n // 5) END AS fold
         FROM t)
       SELECT k.fold::INTEGER AS fold, round(stddev_pop(value), 6) AS spread FROM f, range(4) AS k(fold)
       WHERE f.fold < k.fold GROUP BY 1""",
)
def _spread(spark, sf):
    df = folds.time_folds(table(spark, sf, "events").select("ts", "event_id", "value"), ["ts", "event_id"], 4)
    spread = metrics.train_spread(df, "value", "fold", 4, ordered=True)
    return spread.select("fold", F.round("spread", 6).alias("spread"))


_X = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


@book.query(
    "feature_correlations",
    " UNION ALL ".join(
        f"SELECT '{x}' AS feature, count(*) AS n, round(corr({x}, l_extendedprice), 6) AS correlation FROM lineitem"
        for x in _X
    ),
)
def _correlations(spark, sf):
    out = metrics.correlations(table(spark, sf, "lineitem"), _X, "l_extendedprice")
    return out.select("feature", "n", F.round("correlation", 6).alias("correlation"))


_CATS = ("l_returnflag", "l_linestatus", "l_linenumber")


@book.query(
    "explained_variance",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(b / (b + w), 8) AS eta_squared FROM (
          SELECT sum(n * (m - g) * (m - g)) AS b, sum(n * v) AS w FROM (
            SELECT count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY {c}),
            (SELECT avg(l_extendedprice) AS g FROM lineitem))"""
        for c in _CATS
    ),
)
def _eta(spark, sf):
    bins = metrics.category_bins(table(spark, sf, "lineitem"), _CATS, ["l_extendedprice"])
    out = metrics.explained_variance(bins, "l_extendedprice")
    return out.select("feature", F.round("eta_squared", 8).alias("eta_squared"))


@book.query(
    "mutual_information",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(sum(p * ln(p / (pb * pl))), 8) AS mutual_information FROM (
          SELECT c / sum(c) OVER () AS p, sum(c) OVER (PARTITION BY b) / sum(c) OVER () AS pb,
            sum(c) OVER (PARTITION BY l) / sum(c) OVER () AS pl
          FROM (SELECT {c} AS b, l_returnflag AS l, count(*) AS c FROM lineitem GROUP BY 1, 2))"""
        for c in ("l_linestatus", "l_linenumber")
    ),
)
def _mutual(spark, sf):
    bins = metrics.category_bins(table(spark, sf, "lineitem"), ["l_linestatus", "l_linenumber"], ["l_returnflag"])
    out = metrics.mutual_information(bins, "l_returnflag")
    return out.select("feature", F.round("mutual_information", 8).alias("mutual_information"))


# Missing classes, missing bins and empty strings: rows without a class leave, NULL and '' are bins of their own.
_GAPS_SQL = """SELECT CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN '' ELSE l_linestatus END AS b,
    nullif(l_returnflag, 'N') AS l, l_extendedprice AS y FROM lineitem"""


def _with_gaps(spark, sf):
    bin_ = F.when(F.col("l_linenumber") == 2, "").when(F.col("l_linenumber") != 1, F.col("l_linestatus"))
    rows = table(spark, sf, "lineitem").select(bin_.alias("b"), F.nullif("l_returnflag", F.lit("N")).alias("l"), F.col("l_extendedprice").alias("y"))
    return metrics.category_bins(rows, ["b"], ["l", "y"])


@book.query(
    "mutual_information_gaps",
    f"""SELECT 'b' AS feature, round(sum(p * ln(p / (pb * pl))), 8) AS mutual_information FROM (
      SELECT c / sum(c) OVER () AS p, sum(c) OVER (PARTITION BY b) / sum(c) OVER () AS pb,
        sum(c) OVER (PARTITION BY l) / sum(c) OVER () AS pl
      FROM (SELECT b, l, count(*) AS c FROM ({_GAPS_SQL}) WHERE l IS NOT NULL GROUP BY 1, 2))""",
)
def _mutual_gaps(spark, sf):
    out = metrics.mutual_information(_with_gaps(spark, sf), "l")
    return out.select("feature", F.round("mutual_information", 8).alias("mutual_information"))


@book.query(
    "explained_variance_gaps",
    f"""SELECT 'b' AS feature, round(b / (b + w), 8) AS eta_squared FROM (
      SELECT sum(n * (m - g) * (m - g)) AS b, sum(n * v) AS w FROM (
        SELECT count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM ({_GAPS_SQL}) GROUP BY b),
        (SELECT avg(y) AS g FROM ({_GAPS_SQL})))""",
)
def _eta_gaps(spark, sf):
    out = metrics.explained_variance(_with_gaps(spark, sf), "y")
    return out.select("feature", F.round("eta_squared", 8).alias("eta_squared"))


# Customers are predicted by the mean over the other folds; a customer who is in one fold only has no prediction.
_UNSEEN_SQL = """WITH f AS (SELECT o_orderkey, o_custkey, o_totalprice AS y,
      ((row_number() OVER (ORDER BY md5('42~' || o_orderkey)) - 1) % 4)::INTEGER AS fold FROM orders),
    p AS (SELECT k.fold, o_custkey, avg(y) AS prediction FROM f, range(4) AS k(fold) WHERE f.fold <> k.fold GROUP BY 1, 2),
    s AS (SELECT f.fold, y, prediction FROM f LEFT JOIN p ON f.fold = p.fold AND f.o_custkey = p.o_custkey)"""


def _unseen(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("y"))
    rows = folds.shuffled_folds(rows, ["o_orderkey"], _FOLDS)
    return groups.with_out_of_fold_mean(rows, ["o_custkey"], "y", "fold", "prediction")


@book.query(
    "rmse_unseen_groups",
    f"""{_UNSEEN_SQL} SELECT fold, round(-sqrt(avg((y - prediction) * (y - prediction))), 4) AS score, count(y) AS n,
      count(prediction) AS n_scored FROM s GROUP BY 1""",
)
def _rmse_unseen(spark, sf):
    scores = metrics.fold_scores(_unseen(spark, sf), "rmse", "y", "prediction", ["fold"], unscored="skip")
    return scores.select("fold", F.round("score", 4).alias("score"), "n", "n_scored")


@book.query(
    "accuracy_unseen_groups",
    f"""{_UNSEEN_SQL} SELECT fold, round(avg(CASE WHEN (prediction > 150000) = (y > 150000) THEN 1.0 ELSE 0.0 END), 6) AS score,
      count(y) AS n, count(prediction) AS n_scored FROM s GROUP BY 1""",
)
def _accuracy_unseen(spark, sf):
    rows = _unseen(spark, sf).withColumns({"y": F.col("y") > 150000, "prediction": F.col("prediction") > 150000})
    scores = metrics.fold_scores(rows, "accuracy", "y", "prediction", ["fold"])
    return scores.select("fold", F.round("score", 6).alias("score"), "n", "n_scored")


_DROP_SQL = ", ".join(f"CASE WHEN abs(corr({x}, l_extendedprice)) >= 0.5 THEN 1 ELSE 0 END AS {x}" for x in ("l_quantity", "l_tax", "mass"))


@book.query(
    "drop_uninformative",
    # which features stay follows from their correlations; the columns of dropped ones are NULL
    f"""WITH r AS (SELECT *, l_extendedprice * l_quantity AS mass FROM lineitem), k AS (SELECT {_DROP_SQL} FROM r)
       SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN k.l_quantity = 1 THEN r.l_quantity END AS l_quantity,
         CASE WHEN k.l_tax = 1 THEN r.l_tax END AS l_tax, CASE WHEN k.mass = 1 THEN r.mass END AS mass FROM r, k""",
)
def _drop(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax")
    df = df.withColumn("mass", F.col("l_extendedprice") * F.col("l_quantity"))
    scores = metrics.correlations(df, ["l_quantity", "l_tax", "mass"], "l_extendedprice")
    kept = metrics.drop_uninformative(df, scores, 0.5, "correlation")
    missing = [c for c in ("l_quantity", "l_tax", "mass") if c not in kept.columns]
    return kept.withColumns({c: F.lit(None).cast("double") for c in missing})


# --- filter scores of many features, from exact decile bins

_NUMBERS = ("l_quantity", "l_discount", "l_tax")


def _formula(s):
    """SQL of a proposed feature over the rows of a table; statistics are of all these rows."""
    x = s.inputs
    forms = {
        "absolute": "abs({0})", "log_safe": "ln(1 + abs({0}))", "sqrt": "sqrt(abs({0}))", "sigmoid": "1 / (1 + exp(-{0}))",
        "square": "{0} * {0}", "signed_sqrt": "sign({0}) * sqrt(abs({0}))", "round": "round_even({0}, 2)",
        "multiply": "{0} * {1}", "subtract": "{0} - {1}", "maximum": "greatest({0}, {1})", "minimum": "least({0}, {1})",
        "group_mean": "avg({1}) OVER (PARTITION BY {0})", "group_std": "stddev_samp({1}) OVER (PARTITION BY {0})",
        "group_median": "median({1}) OVER (PARTITION BY {0})", "group_min": "min({1}) OVER (PARTITION BY {0})",
        "group_max": "max({1}) OVER (PARTITION BY {0})", "ratio": "{0} / nullif({1}, 0)", "residual": "{0} - avg({0}) OVER ()",
        "frequency": "count(*) OVER (PARTITION BY {0}) / count({0}) OVER ()",
        "group_rank": "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0",
    }
    return forms[s.op].format(*x)


def _eta_sql(s, source, y, rows="TRUE"):
    """One row (feature, n, correlation, eta_squared) of a feature ``f`` against ``y``, binned at its exact deciles.

    Statistics are of the whole source, the score is of those ``rows``. The feature is computed once, as means differ in the last
    digit from one evaluation to the next, which moves rows across edges.
    """
    edges = ", ".join(f"quantile_cont(f, {i / 10}) AS e{i}" for i in range(1, 10))
    place = " ".join(f"WHEN f <= e{i} THEN {i - 1}" for i in range(1, 10))
    return f"""SELECT '{s.label}' AS feature, max(n) AS n, CASE WHEN NOT isnan(max(r)) THEN round(max(r), 6) END AS correlation,
        sum(c * (m - g) * (m - g)) / max(t) AS eta_squared
      FROM (WITH w AS MATERIALIZED (SELECT ({_formula(s)})::DOUBLE AS f, {y} AS y, {rows} AS used FROM {source}),
          v AS (SELECT f, y FROM w WHERE used)
        SELECT CASE WHEN f IS NULL THEN -1 {place} ELSE 9 END AS b, count(*) AS c, avg(y) AS m,
          any_value(n) AS n, any_value(r) AS r, any_value(g) AS g, any_value(t) AS t
        FROM v, (SELECT {edges}, count(f) AS n, corr(f, y) AS r, avg(y) AS g, var_pop(y) * count(y) AS t FROM v)
        GROUP BY 1)"""


@book.query(
    "batch_filter_scores",
    f"""SELECT feature, n, correlation, round(eta_squared, 6) AS eta_squared
      FROM ({" UNION ALL ".join(_eta_sql(s, "lineitem", "l_extendedprice") for s in search.propose(_NUMBERS, ["l_returnflag"]))})""",
)
def _filter_scores(spark, sf):
    """Every operator of the vocabulary that needs no order of rows and no second category."""
    specs = search.propose(_NUMBERS, ["l_returnflag"])
    scores = search.filter_scores(table(spark, sf, "lineitem"), specs, "l_extendedprice", "regression")
    return scores.select("feature", "n", F.round("correlation", 6).alias("correlation"), F.round("eta_squared", 6).alias("eta_squared"))


_MEASURED = ("c_acctbal", "c_custkey", "c_mktsegment", "c_nationkey")
_OPS_SQL = "(SELECT unnest([{}]) AS op)"


def _ops(names):
    return _OPS_SQL.format(", ".join(f"'{n}'" for n in names))


def _proposals_sql():
    kinds = " UNION ALL ".join(
        f"""SELECT '{c}' AS name, CASE WHEN typeof(any_value({c})) IN ('DOUBLE', 'FLOAT', 'BIGINT', 'INTEGER') AND NOT
          (min({c})::VARCHAR IN ('0', '0.0') AND max({c})::VARCHAR IN ('1', '1.0')) THEN 'numeric' ELSE 'categorical' END AS kind
          FROM customer"""
        for c in _MEASURED
    )
    spans = f"(SELECT unnest({list(search.SPANS)}) AS n)"
    return f"""WITH k AS ({kinds}), x AS (SELECT name FROM k WHERE kind = 'numeric'),
        g AS (SELECT name FROM k WHERE kind = 'categorical')
      SELECT op, [name] AS columns, NULL::INTEGER AS n FROM x, {_ops(search.ONE_NUMBER)}
      UNION ALL SELECT op, [a.name, b.name], NULL FROM x a JOIN x b ON a.name < b.name, {_ops(search.TWO_NUMBERS)}
      UNION ALL SELECT op, [name], NULL FROM k, {_ops(search.ANY_COLUMN)}
      UNION ALL SELECT op, [g.name, x.name], NULL FROM g, x, {_ops(search.GROUP_AND_NUMBER)}
      UNION ALL SELECT op, [a.name, b.name], NULL FROM g a JOIN g b ON a.name <> b.name, {_ops(search.TWO_GROUPS)}
      UNION ALL SELECT op, [a.name, b.name], NULL FROM g a JOIN g b ON a.name < b.name, {_ops(search.TWO_GROUPS_UNORDERED)}
      UNION ALL SELECT op, [name], n FROM x, {_ops(search.SERIES_OF_NUMBER)}, {spans}
      UNION ALL SELECT op, [a.name, b.name], n FROM x a JOIN x b ON a.name < b.name, {_ops(search.SERIES_OF_TWO)}, {spans}"""


@book.query("proposals", f"SELECT op, array_to_string(columns, ',') AS columns, n FROM ({_proposals_sql()})")
def _proposals(spark, sf):
    """The whole vocabulary over the columns of a table, by their measured kinds."""
    made = search.propose_for(table(spark, sf, "customer").select(*_MEASURED, "c_name"), "c_name", series=True)
    rows = search.proposal_rows(spark, made)
    return rows.select("op", F.array_join("columns", ",").alias("columns"), "n")


# --- trees: targets that one split of a feature separates, so that the right score is known; folds and counts follow in SQL


def _fold_counts(key, source, seed=42, k=4):
    return f"""SELECT fold, count(*) AS n FROM (SELECT ((row_number() OVER (ORDER BY md5('{seed}~' || {key})) - 1) % {k})::INTEGER
      AS fold FROM {source}) GROUP BY 1"""


def _exact(scores):
    return scores.select("fold", (F.round("score", 6) + F.lit(0.0)).alias("score"), "n", "n_scored")


@book.query("boosted_tree_regressor", f"SELECT fold, 0.0::DOUBLE AS score, n, n AS n_scored FROM ({_fold_counts('o_orderkey', 'orders')})")
def _regressor(spark, sf):
    rows = table(spark, sf, "orders").withColumn("y", F.when(F.col("o_orderpriority") == "1-URGENT", 64.0).otherwise(16.0))
    df = folds.shuffled_folds(rows, ["o_orderkey"], 4)
    features = ["o_custkey", "o_orderpriority", "o_orderstatus"]
    return _exact(models.cross_validate(df, features, "y", "fold", 4, "regression"))


@book.query(
    "boosted_tree_series",
    """WITH t AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
       f AS (SELECT CASE WHEN i < n - 4 * (n // 5) THEN -1 ELSE (i - (n - 4 * (n // 5))) // (n // 5) END::INTEGER AS fold FROM t)
       SELECT fold, 0.0::DOUBLE AS score, count(*) AS n, count(*) AS n_scored FROM f WHERE fold >= 0 GROUP BY 1""",
)
def _series(spark, sf):
    rows = table(spark, sf, "events").withColumn("y", F.when(F.col("event_type") == "click", 8.0).otherwise(-8.0))
    df = folds.time_folds(rows, ["ts", "event_id"], 4)
    return _exact(models.cross_validate(df, ["user_id", "event_type"], "y", "fold", 4, "series", ordered=True))


@book.query(
    "boosted_tree_classifier",
    """SELECT fold, 1.0::DOUBLE AS score, count(*) AS n, count(*) AS n_scored FROM (
         SELECT ((row_number() OVER (PARTITION BY lang = 'en' ORDER BY md5('42~' || doc_id)) - 1) % 4)::INTEGER AS fold
         FROM labels JOIN documents USING (doc_id)) GROUP BY 1""",
)
def _classifier(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").drop("text"), "doc_id")
    rows = rows.withColumn("english", F.when(F.col("lang") == "en", "yes").otherwise("no"))
    df = folds.stratified_folds(rows, "english", ["doc_id"], 4)
    return _exact(models.cross_validate(df, ["n_chars", "lang", "source"], "english", "fold", 4, "classification"))


@book.query(
    "boosted_tree_multiclass",
    """SELECT fold, 1.0::DOUBLE AS score, count(*) AS n, count(*) AS n_scored FROM (
         SELECT ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42~' || o_orderkey)) - 1) % 4)::INTEGER AS fold
         FROM orders) GROUP BY 1""",
)
def _multiclass(spark, sf):
    df = folds.stratified_folds(table(spark, sf, "orders").withColumn("status", F.col("o_orderstatus")), "o_orderstatus", ["o_orderkey"], 4)
    return _exact(models.cross_validate(df, ["o_totalprice", "status", "o_orderpriority"], "o_orderstatus", "fold", 4, "classification"))


# --- candidates, rounds and the search

_PROTOCOL = protocol.protocol_of("bike")  # outer folds in time order, inner ones shuffled, plain error
_CANDIDATES = {
    "urgent": [spec("group_mean", "o_orderpriority", "y")],
    "status": [spec("frequency", "o_orderstatus"), spec("log_safe", "o_custkey")],
}


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("y", F.when(F.col("o_orderpriority") == "1-URGENT", 64.0).otherwise(16.0))


@book.query(
    "candidate_scores",
    f"""SELECT c.candidate, fold, CASE WHEN c.candidate = 'urgent' THEN 0.0::DOUBLE END AS exact, n, n AS n_scored
        FROM ({_fold_counts('o_orderkey', 'orders')}), (VALUES ('urgent'), ('status')) AS c(candidate)""",
)
def _candidate_scores(spark, sf):
    """Scores of several candidates in one call; the group mean of the target separates it, so its error is zero."""
    df = folds.shuffled_folds(_orders(spark, sf), ["o_orderkey"], 4)
    scores = search.candidate_scores(df, _CANDIDATES, "y", _PROTOCOL, "fold", range(4), False)
    exact = F.when(F.col("candidate") == "urgent", F.round("score", 6) + F.lit(0.0))
    return scores.select("candidate", "fold", exact.alias("exact"), "n", "n_scored")


_ROUND = [*search.propose(["o_custkey", "o_totalprice"], ["o_orderpriority"]), spec("group_mean", "o_orderpriority", "y")]


def _round_sql():
    def of_fold(s, j):
        # ranks are places among all rows, all other statistics are learned from the training rows
        return _eta_sql(s, "t" if s.op == "group_rank" else f"(SELECT * FROM t WHERE fold <> {j})", "y", f"fold <> {j}")

    parts = " UNION ALL ".join(f"SELECT feature, eta_squared FROM ({of_fold(s, j)})" for s in _ROUND for j in range(4))
    return f"""WITH t AS MATERIALIZED (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 64.0::DOUBLE ELSE 16.0::DOUBLE END AS y,
        ((row_number() OVER (ORDER BY md5('42~' || o_orderkey)) - 1) % 4)::INTEGER AS fold FROM orders),
      f AS (SELECT feature, avg(eta_squared) AS filter_score FROM ({parts}) GROUP BY 1),
      r AS (SELECT *, row_number() OVER (ORDER BY round(filter_score, 9) DESC NULLS LAST, feature) = 1 AS best FROM f),
      p AS (SELECT k.fold, o_orderpriority, avg(y) AS prediction FROM t, range(4) AS k(fold) WHERE t.fold <> k.fold GROUP BY 1, 2),
      e AS (SELECT fold, -sqrt(avg((y - prediction) * (y - prediction))) AS score FROM t JOIN p USING (fold, o_orderpriority) GROUP BY 1)
      SELECT feature, round(filter_score, 6) AS filter_score, best, CASE WHEN best THEN round((SELECT avg(score) FROM e), 6) + 0.0 END AS score
      FROM r"""


@book.query("evaluate_round", _round_sql())
def _round(spark, sf):
    """Filter scores of the vocabulary over the training rows of four folds; the best by filter is validated with trees.

    The target depends on the priority alone, so trees on a feature that tells priorities apart err as little as
    the mean of each priority does.
    """
    df = folds.shuffled_folds(_orders(spark, sf), ["o_orderkey"], 4)
    found = search.evaluate_round(df, _ROUND, "y", _PROTOCOL, "fold", keep=1)
    return found.select(
        "feature", F.round("filter_score", 6).alias("filter_score"), F.col("score").isNotNull().alias("best"),
        (F.round("score", 6) + F.lit(0.0)).alias("score"),
    )


@book.query("feature_search")
def _search(spark, sf):
    """The whole vocabulary and, in a second generation, what deepens the best of it, on all outer and inner folds."""
    df = table(spark, sf, "customer")
    return search.search(
        df, ["c_custkey", "c_nationkey"], ["c_mktsegment"], "c_acctbal", protocol.protocol_of(task="regression"),
        ["c_custkey"], order_by=["c_custkey"], generations=2,
    )


@book.query(
    "hold_out_score",
    "SELECT 0 AS outer_fold, 0.0::DOUBLE AS score",
)
def _hold_out(spark, sf):
    df = folds.shuffled_folds(_orders(spark, sf), ["o_orderkey"], 5, out="outer")
    best = [spec("group_mean", "o_orderpriority", "y"), spec("log_safe", "o_custkey")]
    shuffled = protocol.Protocol("regression", "rmse", "shuffled", "shuffled")
    held = search.hold_out_score(df, best, "y", shuffled, "outer", 0, ["o_custkey"])
    return held.select("outer_fold", (F.round("score", 6) + F.lit(0.0)).alias("score"))


@book.query(
    "protocol_group_mean",
    """WITH t AS (SELECT event_id, event_type, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n
         FROM events),
       o AS (SELECT *, CASE WHEN i < n - 5 * (n // 6) THEN -1 ELSE (i - (n - 5 * (n // 6))) // (n // 6) END AS outer_fold FROM t),
       f AS (SELECT j.outer_fold, event_id, event_type, value, ((row_number() OVER (PARTITION BY j.outer_fold
           ORDER BY md5('42~' || event_id)) - 1) % 4)::INTEGER AS fold
         FROM o, range(5) AS j(outer_fold) WHERE o.outer_fold < j.outer_fold),
       p AS (SELECT f.outer_fold, k.fold, event_type, avg(value) AS prediction FROM f, range(4) AS k(fold)
         WHERE f.fold <> k.fold GROUP BY 1, 2, 3)
       SELECT f.outer_fold::INTEGER AS outer_fold, f.fold, round(-sqrt(avg((value - prediction) * (value - prediction))), 6) AS score,
         count(*) AS n FROM f JOIN p USING (outer_fold, fold, event_type) GROUP BY 1, 2""",
)
def _protocol(spark, sf):
    """Outer folds in time order, inner folds shuffled, negated error, with the group mean as predictor."""
    df = table(spark, sf, "events").select("event_id", "event_type", "value", "ts")
    ids, order = ["event_id"], ["ts", "event_id"]
    placed = _PROTOCOL.assign(df, "outer", "value", ids, order, "outer", 42)
    parts = []
    for j in range(_PROTOCOL.outer_folds):
        train = placed.filter(folds.is_train(F.col("outer"), j, _PROTOCOL.ordered("outer"))).drop("outer")
        inner = _PROTOCOL.assign(train, "inner", "value", ids, order, "fold", 42)
        predicted = groups.with_out_of_fold_mean(inner, ["event_type"], "value", "fold", "prediction")
        scores = metrics.fold_scores(predicted, _PROTOCOL.metric, "value", "prediction", ["fold"])
        parts.append(scores.select(F.lit(j).alias("outer_fold"), "fold", F.round("score", 6).alias("score"), "n"))
    return models.union_all(parts)
