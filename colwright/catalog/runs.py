"""Candidate logs, populations, reviews and streaming. Candidates are derived from the events table.

An event stands for a candidate: its type is the run, its id the step, its rounded value the score; errors have none.
The text expressions are plain SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from colwright.catalog.base import Book, table
from colwright.functions import programs as text
from colwright.operators.lookup import with_program_score, with_prompt
from colwright.plans import batches, population, review
from colwright.sources import runlog
from colwright.storage import new_path
from colwright.streaming import progress as streaming

book = Book()

_SCORE = "CASE WHEN event_type <> 'error' THEN round(value, 0) / 1000 END"

_NL = "chr(10)"

#: Program text of an event: documented features, assignments, and what some runs do wrong.
_PROGRAM = f"""concat(
  CASE WHEN user_id % 3 = 0 THEN 'def modify_features' ELSE concat('def modify_features_v', user_id % 3) END, '(df_input):',
  {_NL}, '  # better than modify_features_v0(df_input)', {_NL}, '  said = "modify_features_v1(df_input)"', {_NL},
  CASE WHEN event_type = 'click'
    THEN concat('  Thought: gate ', user_id, ' | New Feature: g_', event_id, ' = a + ', user_id, {_NL})
    ELSE concat('  Thought 1: scale by ', user_id, {_NL},
      CASE WHEN event_type = 'error' THEN '' ELSE concat('  New Feature 1: f_', event_id, ' | f_', event_id,
        ' = (', event_type, ' * ', user_id, ')', {_NL}) END,
      '  Thought 2: keep it', {_NL}, '  New Feature 2: h_', event_id, ' | h_', event_id, ' = log(x)', {_NL}) END,
  CASE WHEN event_type = 'view' THEN concat('  <Operators> only', {_NL}) ELSE '' END,
  '  This program scored: ', user_id, {_NL},
  '    df_output = df_input.copy()', {_NL},
  CASE WHEN event_type = 'error' THEN concat('    for x in df_input:', {_NL}, '      pass', {_NL}) ELSE '' END,
  '    df_output[''f_', event_id, '''] = df_input[''', event_type, '''] * ', user_id, {_NL},
  '    if df_output[''f_', event_id, '''] == 1: pass', {_NL},
  CASE WHEN event_type = 'view' THEN chr(9) ELSE '    ' END, 'df_output["h_', event_id, '"] = ',
  CASE WHEN event_type = 'signup' THEN 'x.shift(-1)' ELSE 'x.shift(1)' END, {_NL},
  CASE WHEN event_type = 'purchase' THEN concat('    return modify_features_v1(df_output)', {_NL}) ELSE '' END,
  '    return df_output')"""

#: The lines of ``_PROGRAM`` that assign to the output frame.
_CODE = f"""concat('    df_output[''f_', event_id, '''] = df_input[''', event_type, '''] * ', user_id, {_NL},
  CASE WHEN event_type = 'view' THEN chr(9) ELSE '    ' END, 'df_output["h_', event_id, '"] = ',
  CASE WHEN event_type = 'signup' THEN 'x.shift(-1)' ELSE 'x.shift(1)' END)"""


def _candidates(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("run_id"),
        F.col("event_id").alias("step"),
        (F.col("user_id") % 2).cast("int").alias("island_id"),
        (F.col("user_id") % 5).cast("int").alias("split"),
        F.expr(_SCORE).alias("score"),
        (F.col("value") / 100).alias("sample_time"),
        (F.col("value") / 50).alias("evaluate_time"),
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("prompt_id"),
    )


_CAND = f"""c AS (SELECT event_type AS run_id, event_id AS step, (user_id % 2)::INTEGER AS island_id,
  (user_id % 5)::INTEGER AS split, {_SCORE} AS score, value / 100 AS sample_time, value / 50 AS evaluate_time,
  'p' || user_id AS prompt_id FROM events)"""


_CLUSTERS = f"""{_CAND}, k AS (SELECT island_id, score, count(*) AS n_programs, min(step) AS first_step FROM c
  WHERE score IS NOT NULL GROUP BY 1, 2)"""


def _programs(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr(_PROGRAM).alias("code"))


# program text


@book.query("code_lines", f"SELECT event_id, {_CODE} AS v FROM events")
def _code_lines(spark, sf):
    return _programs(spark, sf).select("event_id", text.code_lines(F.col("code")).alias("v"))


@book.query(
    "without_score_lines",
    f"""SELECT event_id, replace({_PROGRAM}, concat('  This program scored: ', user_id, {_NL}), '') AS v FROM events""",
)
def _no_scores(spark, sf):
    return _programs(spark, sf).select("event_id", text.without_score_lines(F.col("code")).alias("v"))


@book.query(
    "assigned_features",
    """SELECT event_id, 'f_' || event_id AS feature FROM events UNION ALL SELECT event_id, 'h_' || event_id FROM events""",
)
def _assigned(spark, sf):
    return _programs(spark, sf).select(
        "event_id", F.explode(text.assigned_features(F.col("code"))).alias("feature")
    )


@book.query(
    "feature_catalog",
    """SELECT event_id, 0 AS position, 'gate ' || user_id AS thought, 'g_' || event_id AS feature_name,
         'a + ' || user_id AS formula FROM events WHERE event_type = 'click'
       UNION ALL SELECT event_id, 0, 'scale by ' || user_id, 'f_' || event_id, '(' || event_type || ' * ' || user_id || ')'
         FROM events WHERE event_type NOT IN ('click', 'error')
       UNION ALL SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, 'keep it', 'h_' || event_id, 'log(x)'
         FROM events WHERE event_type <> 'click'""",
)
def _catalog(spark, sf):
    return text.feature_catalog(_programs(spark, sf), "code", "event_id")


@book.query(
    "head_type",
    "SELECT event_id, CASE WHEN event_type = 'view' THEN 'operations' ELSE 'domain' END AS v FROM events",
)
def _head(spark, sf):
    return _programs(spark, sf).select("event_id", text.head_type(F.col("code")).alias("v"))


_RECORD = f"""concat('--- Program Index ', event_id, ' ---', {_NL}, 'Score: ',
  coalesce(({_SCORE})::VARCHAR, 'None'), {_NL}, 'Code:', {_NL}, {_CODE}, {_NL})"""


@book.query("record_text", f"SELECT event_id, {_RECORD} AS v, length({_RECORD})::INTEGER AS n FROM events")
def _record(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.expr(_SCORE).alias("score"), text.code_lines(F.expr(_PROGRAM)).alias("code")
    )
    v = text.record_text(F.col("event_id"), F.col("score"), F.col("code"))
    return rows.select("event_id", v.alias("v"), F.length(v).alias("n"))


@book.query(
    "lint_programs",
    """SELECT event_id, event_type = 'error' AS has_loop, user_id % 3 <> 0 OR event_type = 'purchase' AS calls_ancestor,
         event_type = 'signup' AS looks_ahead
       FROM events""",
)
def _lint(spark, sf):
    return review.lint_programs(_programs(spark, sf), "code").drop("code")


# logs and run tables


def _log_rows(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("run_id"),
        (F.col("user_id") % 5).cast("int").alias("split"),
        F.col("event_id").alias("sample_order"),
        (F.lit(1_700_000_000) + F.col("event_id")).cast("long").alias("timestamp"),
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("prompt_id"),
        F.expr(_PROGRAM).alias("generated_program"),
        F.expr(_SCORE).alias("score"),
    )


@book.query(
    "candidate_log",
    f"""SELECT event_type AS run_id, (user_id % 5)::INTEGER AS split, event_id AS sample_order,
       1700000000 + event_id AS timestamp, 'p' || user_id AS prompt_id, {_CODE} AS generated_program, {_SCORE} AS score
       FROM events""",
)
def _log(spark, sf):
    path = new_path(spark, "log")
    runlog.append_log(_log_rows(spark, sf), path)
    return runlog.read_log(spark, path)


def _append_cut_lines(spark, sf, path):
    cut = table(spark, sf, "events").filter("user_id % 7 = 3").select(
        F.concat(F.lit("{broken "), F.col("event_id").cast("string")).alias("value"),
        F.col("event_type").alias("run_id"), (F.col("user_id") % 5).cast("int").alias("split"),
    )
    runlog.by_file(cut).write.mode("append").partitionBy("run_id", "split").text(path)


@book.query(
    "malformed_log_lines",
    f"""SELECT event_type AS run_id, (user_id % 5)::INTEGER AS split, '{{broken ' || event_id AS line
       FROM events WHERE user_id % 7 = 3""",
)
def _malformed(spark, sf):
    """A log into which every run has also written cut-off lines."""
    path = new_path(spark, "log")
    runlog.append_log(_log_rows(spark, sf), path)
    _append_cut_lines(spark, sf, path)
    return runlog.malformed_lines(spark, path)


@book.query(
    "candidate_records",
    f"""SELECT event_type AS run_id, event_id AS sample_order, (user_id % 2)::INTEGER AS island_id,
       {_SCORE} AS cluster_signature, {_SCORE} AS score, 'f_' || event_id AS function FROM events""",
)
def _records(spark, sf):
    path = new_path(spark, "candidates")
    rows = _candidates(spark, sf).select(
        "run_id",
        F.col("step").alias("sample_order"),
        "island_id",
        F.when(F.col("score").isNotNull(), F.array("score")).otherwise(F.array().cast("array<double>")).alias("signature"),
        F.concat(F.lit("f_"), F.col("step").cast("string")).alias("function"),
        "score",
    )
    runlog.write_candidates(rows, path)
    return spark.read.parquet(path)


@book.query(
    "prompt_table",
    """SELECT min(event_id) AS prompt_step, (user_id % 5)::INTEGER AS split_id, (user_id % 2)::INTEGER AS island_id,
       'p' || user_id AS prompt_id, 2 AS version_generated, 'domain' AS head_type, count(*) AS num_samples
       FROM events GROUP BY user_id""",
)
def _prompt_table(spark, sf):
    path = new_path(spark, "tables")
    runlog.write_run_table(_prompts(spark, sf), "prompts", path)
    return runlog.read_run_table(spark, "prompts", path)


def _prompts(spark, sf):
    return _candidates(spark, sf).groupBy("prompt_id").agg(
        F.min("step").alias("prompt_step"),
        F.first("split").alias("split_id"),
        F.first("island_id").alias("island_id"),
        F.lit(2).alias("version_generated"),
        F.lit("domain").alias("head_type"),
        F.count(F.lit(1)).alias("num_samples"),
    )


@book.query(
    "proposal_table",
    f"""WITH {_CAND} SELECT step AS global_step, split AS split_id, island_id, score, sample_time, evaluate_time,
       score AS cluster_signature, score AS cluster_reduced_score, 'f_' || step AS function_str, prompt_id,
       'domain' AS head_type, 2 AS version_generated FROM c""",
)
def _proposals(spark, sf):
    path = new_path(spark, "tables")
    rows = _candidates(spark, sf).select(
        F.col("step").alias("global_step"),
        F.col("split").alias("split_id"),
        "island_id",
        "score",
        "sample_time",
        "evaluate_time",
        F.col("score").alias("cluster_signature"),
        F.col("score").alias("cluster_reduced_score"),
        F.concat(F.lit("f_"), F.col("step").cast("string")).alias("function_str"),
        "prompt_id",
        F.lit("domain").alias("head_type"),
        F.lit(2).alias("version_generated"),
    )
    runlog.write_run_table(rows, "proposals", path)
    return runlog.read_run_table(spark, "proposals", path)


@book.query(
    "best_update_table",
    f"""WITH {_CAND}, b AS (SELECT island_id, score, step, max(score) OVER (PARTITION BY island_id ORDER BY step
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c WHERE score IS NOT NULL)
       SELECT island_id, score AS updated_score, step AS global_step FROM b WHERE best IS NULL OR score > best""",
)
def _best_updates(spark, sf):
    path = new_path(spark, "tables")
    runlog.write_run_table(population.best_updates(_candidates(spark, sf)), "best_updates", path)
    return runlog.read_run_table(spark, "best_updates", path)


@book.query(
    "pre_reseed_table",
    f"""WITH {_CLUSTERS}, n AS (SELECT max(step) AS global_step FROM c)
       SELECT global_step, island_id, count(*) AS num_clusters, round(avg(score), 6) AS mean_score,
         round(var_pop(score), 8) AS variance, max(score) AS best_score FROM k, n GROUP BY 1, 2""",
)
def _pre_reseed(spark, sf):
    path = new_path(spark, "tables")
    last = _candidates(spark, sf).agg(F.max("step").alias("global_step"))
    stats = population.island_statistics(population.clusters(_with_signature(spark, sf)))
    runlog.write_run_table(stats.crossJoin(F.broadcast(last)), "pre_reseed", path)
    back = runlog.read_run_table(spark, "pre_reseed", path)
    return back.withColumns({"mean_score": F.round("mean_score", 6), "variance": F.round("variance", 8)})


@book.query(
    "candidate_prompt_link",
    f"""WITH {_CAND}, p AS (SELECT prompt_id, min(step) AS prompt_step, count(*) AS num_samples FROM c GROUP BY 1)
       SELECT step, prompt_step, num_samples FROM c JOIN p USING (prompt_id)""",
)
def _prompt_link(spark, sf):
    linked = with_prompt(_candidates(spark, sf), _prompts(spark, sf), ["prompt_step", "num_samples"])
    return linked.select("step", "prompt_step", "num_samples")


@book.query(
    "new_candidates",
    f"""SELECT event_type AS run_id, event_id // 3 AS sample_order, min(event_id) AS step
       FROM events WHERE NOT (event_type = 'view' AND event_id < 500) GROUP BY 1, 2
       HAVING (event_type, event_id // 3) NOT IN
         (SELECT (event_type, event_id // 3) FROM events WHERE event_type = 'view' AND event_id < 500)""",
)
def _new(spark, sf):
    """The first record of each (run, order), without those in the log already."""
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("run_id"),
        F.floor(F.col("event_id") / 3).alias("sample_order"),
        F.col("event_id").alias("step"),
        F.col("event_id").alias("timestamp"),
        F.lit("").alias("prompt_id"),
    )
    logged = rows.filter((F.col("run_id") == "view") & (F.col("step") < 500))
    fresh = rows.filter(~((F.col("run_id") == "view") & (F.col("step") < 500)))
    return runlog.new_candidates(fresh, logged).select("run_id", "sample_order", "step")


# population


@book.query(
    "successful_candidates", f"WITH {_CAND} SELECT step, score FROM c WHERE score IS NOT NULL"
)
def _success(spark, sf):
    return population.successes(_candidates(spark, sf)).select("step", "score")


@book.query(
    "scores_per_test",
    """SELECT event_id, round((value + user_id) / 2, 6) AS mean_score, value AS first, user_id::DOUBLE AS second
       FROM events""",
)
def _per_test(spark, sf):
    scores = F.create_map(F.lit("b"), F.col("user_id").cast("double"), F.lit("a"), F.col("value"))
    rows = table(spark, sf, "events").select("event_id", scores.alias("scores"))
    sig = population.signature(F.col("scores"))
    return rows.select(
        "event_id",
        F.round(population.mean_score(F.col("scores")), 6).alias("mean_score"),
        sig[0].alias("first"),
        sig[1].alias("second"),
    )


def _with_signature(spark, sf):
    return _candidates(spark, sf).withColumn("signature", F.array("score", F.round(F.col("score") * 2, 2)))


@book.query("clusters", f"WITH {_CLUSTERS} SELECT island_id, score, n_programs, first_step FROM k")
def _clusters(spark, sf):
    return population.clusters(_with_signature(spark, sf)).drop("signature")


@book.query(
    "island_best",
    f"""WITH {_CAND} SELECT island_id, max(score) AS best_score, arg_min(step, (-score, step)) AS best_step
       FROM c WHERE score IS NOT NULL GROUP BY 1""",
)
def _island_best(spark, sf):
    return population.island_best(_candidates(spark, sf))


@book.query(
    "island_statistics",
    f"""WITH {_CLUSTERS} SELECT island_id, count(*) AS num_clusters, round(avg(score), 6) AS mean_score,
       round(var_pop(score), 8) AS variance, max(score) AS best_score FROM k GROUP BY 1""",
)
def _island_statistics(spark, sf):
    stats = population.island_statistics(population.clusters(_with_signature(spark, sf)))
    return stats.select(
        "island_id",
        "num_clusters",
        F.round("mean_score", 6).alias("mean_score"),
        F.round("variance", 8).alias("variance"),
        "best_score",
    )


_T = 0.1
_SOFTMAX = f"""{_CLUSTERS}, w AS (SELECT island_id, first_step, exp((score - max(score) OVER p) / {_T}) AS e,
  n_programs FROM k WINDOW p AS (PARTITION BY island_id)),
  s AS (SELECT island_id, first_step, e / sum(e) OVER (PARTITION BY island_id) AS p FROM w)"""


@book.query("softmax", f"WITH {_SOFTMAX} SELECT island_id, first_step, round(p, 8) AS p FROM s")
def _softmax(spark, sf):
    weighted = population.softmax(
        population.clusters(_with_signature(spark, sf)), ["island_id"], "score", _T, "first_step", "p"
    )
    return weighted.select("island_id", "first_step", F.round("p", 8).alias("p"))


#: A uniform number from the digest of (seed, draw, id): the first 13 hex digits over 16^13.
_UNIFORM = "((('0x' || substr(md5('42~' || draw || '~' || {id}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


@book.query(
    "sample_clusters",
    f"""WITH {_SOFTMAX}, r AS (SELECT island_id, draw, first_step,
         -ln({_UNIFORM.format(id='first_step')}) / p AS t, count(*) OVER (PARTITION BY island_id, draw) AS k
         FROM s, range(2) AS d(draw))
       SELECT island_id, draw::INTEGER AS draw, arg_min(first_step, (t, first_step)) AS first_step FROM r
       WHERE draw < k GROUP BY 1, 2""",
)
def _sample_clusters(spark, sf):
    return population.sample_clusters(population.clusters(_with_signature(spark, sf)), _T).select(
        "island_id", "draw", "first_step"
    )


@book.query(
    "sample_programs",
    f"""WITH c AS (SELECT (user_id % 2)::INTEGER AS island_id, event_type, event_id AS step,
         length({_CODE}) AS n FROM events),
       l AS (SELECT *, -(n - min(n) OVER p) / (max(n) OVER p + 1e-6::DOUBLE) AS logit FROM c
         WINDOW p AS (PARTITION BY island_id, event_type)),
       w AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY island_id, event_type)) AS e FROM l),
       s AS (SELECT *, e / sum(e) OVER (PARTITION BY island_id, event_type) AS p, 0 AS draw FROM w)
       SELECT island_id, event_type, arg_min(step, (-ln({_UNIFORM.format(id='step')}) / p, step)) AS step
       FROM s GROUP BY 1, 2""",
)
def _sample_programs(spark, sf):
    rows = table(spark, sf, "events").select(
        (F.col("user_id") % 2).cast("int").alias("island_id"),
        "event_type",
        F.col("event_id").alias("step"),
        F.length(text.code_lines(F.expr(_PROGRAM))).alias("n"),
    )
    drawn = population.sample_programs(rows, "n", by=["island_id", "event_type"])
    return drawn.select("island_id", "event_type", "step")


@book.query(
    "order_in_prompt",
    f"""WITH {_CAND} SELECT prompt_id, run_id, step,
       (row_number() OVER (PARTITION BY prompt_id, run_id ORDER BY score NULLS FIRST, step) - 1)::INTEGER AS version FROM c""",
)
def _order_in_prompt(spark, sf):
    ordered = population.order_in_prompt(_candidates(spark, sf), ["prompt_id", "run_id"])
    return ordered.select("prompt_id", "run_id", "step", "version")


_PROGRESS = f"""WITH {_CAND}, b AS (SELECT run_id, step, max(score) OVER w AS best_score,
    count(score) OVER w AS successes, count(*) OVER w - count(score) OVER w AS failures,
    round(sum(sample_time) OVER w, 4) AS total_sample_time, round(sum(evaluate_time) OVER w, 4) AS total_evaluate_time
    FROM c WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING)),
  f AS (SELECT run_id, score, min(step) AS s FROM c WHERE score IS NOT NULL GROUP BY 1, 2)
  SELECT b.*, f.s AS best_step FROM b LEFT JOIN f ON f.run_id = b.run_id AND f.score = b.best_score"""

_PROGRESS_COLUMNS = ("run_id", "step", "best_score", "best_step", "successes", "failures")


def _progress(spark, sf, **options):
    out = population.running_progress(_candidates(spark, sf), **options)
    times = [F.round(c, 4).alias(c) for c in ("total_sample_time", "total_evaluate_time")]
    return out.select(*_PROGRESS_COLUMNS, *times)


book.add("running_progress", _progress, _PROGRESS)
book.add("running_progress_blocks", lambda spark, sf: _progress(spark, sf, key_rows=0, block_rows=1_500), _PROGRESS)

_HISTOGRAM = f"""WITH {_CAND} SELECT step, island_id, round(score, 6) AS cluster,
  count(*) OVER (PARTITION BY island_id, round(score, 6) ORDER BY step) AS cluster_count FROM c"""


def _histogram(spark, sf, **options):
    rows = _candidates(spark, sf).withColumn("signature_value", F.col("score"))
    return population.running_histogram(rows, **options).select("step", "island_id", "cluster", "cluster_count")


book.add("running_histogram", _histogram, _HISTOGRAM)
book.add("running_histogram_blocks", lambda spark, sf: _histogram(spark, sf, key_rows=0, block_rows=1_500), _HISTOGRAM)


@book.query(
    "split_metrics",
    f"""WITH {_CAND} SELECT run_id, split AS split_id, step AS global_step, island_id, score, sample_time,
       evaluate_time, score AS island_score FROM c""",
)
def _split_metrics(spark, sf):
    return population.split_metrics(_candidates(spark, sf))


# reviews

_CLASS = """CASE WHEN event_type = 'error' THEN 'Makes no sense' WHEN event_type = 'view' THEN 'No impact'
  WHEN event_type = 'click' THEN 'Makes sense' END"""


def _responses(spark, sf):
    """One review response per event: a list, an object, or text that is neither."""
    record = F.struct(
        F.col("event_id").alias("program_index"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("f_"), F.col("event_id").cast("string"))).alias(
            "feature_name"
        ),
        F.expr(_CLASS).alias("classification"),
        F.col("props").alias("reasoning"),
    )
    as_list = F.to_json(F.array(record))
    response = F.when(F.col("user_id") % 3 == 0, as_list).when(
        F.col("user_id") % 3 == 1, F.concat(F.lit('{"review": '), as_list, F.lit("}"))
    ).otherwise(F.lit("no answer"))
    return table(spark, sf, "events").select(F.col("event_type").alias("run_id"), response.alias("response"))


@book.query(
    "parse_reviews",
    f"""SELECT event_type AS run_id, event_id AS program_index,
       CASE WHEN event_type <> 'signup' THEN 'f_' || event_id END AS feature_name, NULL::VARCHAR AS code_snippet,
       {_CLASS} AS classification, props AS reasoning FROM events WHERE user_id % 3 < 2""",
)
def _parse(spark, sf):
    return review.parse_reviews(_responses(spark, sf), "response", "run_id")


_REVIEWS = f"""{_CAND}, r AS (SELECT event_type AS run_id, event_id AS program_index,
  CASE WHEN event_type <> 'signup' THEN 'f_' || event_id ELSE 'Unknown' END AS feature_name,
  coalesce({_CLASS}, 'N/A') AS classification, props AS reasoning, '' AS code_snippet,
  {_SCORE} AS score FROM events WHERE user_id % 3 < 2)"""


def _reviews(spark, sf):
    parsed = review.parse_reviews(_responses(spark, sf), "response", "run_id")
    return review.review_table(parsed, _candidates(spark, sf).withColumnRenamed("step", "program_index"))


@book.query("review_table", f"WITH {_REVIEWS} SELECT * FROM r")
def _review_table(spark, sf):
    return _reviews(spark, sf)


@book.query(
    "review_score_lookup",
    f"""WITH {_CAND} SELECT doc_id * 20 AS program_index, CASE WHEN step IS NULL THEN 0 ELSE score END AS score
       FROM labels LEFT JOIN c ON doc_id * 20 = step""",
)
def _score_lookup(spark, sf):
    # some of these indexes match no candidate
    reviews = table(spark, sf, "labels").select((F.col("doc_id") * 20).alias("program_index"))
    candidates = _candidates(spark, sf).withColumnRenamed("step", "program_index")
    return with_program_score(reviews, candidates, ["program_index"])


@book.query("review_class_counts", f"WITH {_REVIEWS} SELECT classification, count(*) AS n FROM r GROUP BY 1")
def _class_counts(spark, sf):
    return review.class_counts(_reviews(spark, sf))


@book.query(
    "review_class_scores",
    f"""WITH {_REVIEWS} SELECT classification, count(score) AS n, min(score) AS low, max(score) AS high,
       round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS median,
       round(quantile_cont(score, 0.75), 6) AS q3 FROM r GROUP BY 1""",
)
def _class_scores(spark, sf):
    box = review.class_scores(_reviews(spark, sf))
    return box.select(
        "classification", "n", "low", "high", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")]
    )


@book.query(
    "review_sink",
    f"WITH {_REVIEWS} SELECT run_id, program_index, feature_name, code_snippet, classification, reasoning FROM r",
)
def _review_sink(spark, sf):
    path = new_path(spark, "reviews")
    rows = _reviews(spark, sf)
    runlog.write_reviews(rows, path)
    columns = ("run_id", "program_index", "feature_name", "code_snippet", "classification", "reasoning")
    return spark.read.schema(rows.select(*columns).schema).json(path)


@book.query(
    "concatenate_reviews",
    """SELECT doc_id, 'quality' AS kind, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels""",
)
def _concatenate(spark, sf):
    labels = table(spark, sf, "labels")
    return review.concatenate_reviews(
        [labels.select("doc_id", F.lit(k).alias("kind"), F.col(k).alias("v")) for k in ("quality", "toxic")]
    )


@book.query(
    "token_usage",
    """SELECT conv_id, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END)::BIGINT AS input_tokens,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS output_tokens,
       0::BIGINT AS thought_tokens, sum(length(text))::BIGINT AS total_tokens FROM conversations GROUP BY 1""",
)
def _tokens(spark, sf):
    n = F.length("text")
    usage = table(spark, sf, "conversations").select(
        "conv_id",
        F.when(F.col("role") == "user", n).alias("input_tokens"),
        F.when(F.col("role") == "assistant", n).alias("output_tokens"),
        F.lit(None).cast("long").alias("thought_tokens"),
        n.alias("total_tokens"),
    )
    return review.token_usage(usage, "conv_id")


_PACK_SQL = """WITH RECURSIVE d AS (SELECT {run} AS run, doc_id, n_chars AS size,
    row_number() OVER (PARTITION BY {run} ORDER BY doc_id) AS i FROM documents),
  b AS (SELECT run, doc_id, i, size, size AS fill, 0::BIGINT AS batch_id FROM d WHERE i = 1
    UNION ALL SELECT d.run, d.doc_id, d.i, d.size,
      CASE WHEN b.fill + d.size > 40000 THEN d.size ELSE b.fill + d.size END,
      CASE WHEN b.fill + d.size > 40000 THEN b.batch_id + 1 ELSE b.batch_id END
    FROM b JOIN d ON d.run = b.run AND d.i = b.i + 1)
  SELECT doc_id, batch_id FROM b"""


@book.query("pack_batches", _PACK_SQL.format(run="source"))
def _pack(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return batches.pack_batches(docs, ["source"], ["doc_id"], "n_chars", 40_000).select("doc_id", "batch_id")


@book.query("pack_batches_one_run", _PACK_SQL.format(run="1"))
def _pack_one(spark, sf):
    """All documents as one run, cut into blocks whose summaries are chained."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return batches.pack_batches(docs, [], ["doc_id"], "n_chars", 40_000, block_rows=1_000, fan=8).select("doc_id", "batch_id")


# review by rules: parts stand for proposed features

_OPS = ("multiply", "log_safe", "add", "group_mean", "lag", "ratio")


def _specs(spark, sf):
    op = F.element_at(F.array(*[F.lit(o) for o in _OPS]), (F.col("p_size") % 6 + 1).cast("int"))
    inputs = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("price"), F.lit("segment"))).when(
        F.col("p_partkey") % 4 == 1, F.array(F.lit("price"), F.lit("weight"))
    ).when(F.col("p_partkey") % 4 == 2, F.array(F.lit("price"), F.lit("is_new"))).otherwise(
        F.array(F.lit("customer_id"))
    )
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("feature"),
        op.alias("op"),
        F.when(op == "group_mean", F.lit("group")).when(op == "lag", F.lit("series")).otherwise(F.lit("scalar")).alias(
            "family"
        ),
        inputs.alias("inputs"),
        (F.col("p_size") % 4).cast("int").alias("n"),
        (F.col("p_size") > 25).alias("fitted"),
    )


@book.query(
    "review_by_rules",
    """WITH s AS (SELECT p_partkey::VARCHAR AS feature, p_partkey % 4 AS i, p_size % 4 AS n, p_size > 25 AS fitted,
         ['multiply', 'log_safe', 'add', 'group_mean', 'lag', 'ratio'][p_size % 6 + 1] AS op FROM part),
       r AS (SELECT feature, op, CASE
         WHEN op = 'group_mean' AND NOT fitted THEN 'leakage'
         WHEN op = 'lag' AND n <= 0 THEN 'leakage'
         WHEN op = 'log_safe' AND i IN (0, 3) THEN 'type error'
         WHEN op = 'multiply' AND i IN (0, 3) THEN 'magnitude of a category code'
         WHEN op = 'add' AND i = 1 THEN 'incompatible units' ELSE '' END AS reasoning FROM s)
       SELECT feature, op, CASE WHEN reasoning = '' THEN 'Makes sense' ELSE 'Makes no sense' END AS classification,
         reasoning FROM r""",
)
def _rules(spark, sf):
    columns = spark.createDataFrame(
        [
            ("price", "continuous", "dollars", False),
            ("weight", "continuous", "kg", False),
            ("is_new", "boolean", None, False),
            ("segment", "nominal", None, False),
            ("customer_id", "nominal", None, True),
        ],
        "name string, kind string, unit string, is_id boolean",
    )
    return review.review_specs(_specs(spark, sf), columns)


@book.query(
    "redundant_features",
    """WITH x AS (SELECT l_quantity AS q, l_extendedprice AS p, 3 * l_extendedprice + 10 AS lin,
         ln(1 + abs(l_extendedprice)) AS mono, -sqrt(abs(l_extendedprice)) AS neg FROM lineitem),
       r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp,
         rank() OVER (ORDER BY lin) + (count(*) OVER (PARTITION BY lin) - 1) / 2.0 AS rlin,
         rank() OVER (ORDER BY mono) + (count(*) OVER (PARTITION BY mono) - 1) / 2.0 AS rmono,
         rank() OVER (ORDER BY neg) + (count(*) OVER (PARTITION BY neg) - 1) / 2.0 AS rneg,
         rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS rq FROM x)
       SELECT 'lin' AS feature, round(corr(lin, p), 6) AS correlation, round(corr(rlin, rp), 6) AS rank_correlation,
         true AS linear, true AS monotone FROM r
       UNION ALL SELECT 'mono', round(corr(mono, p), 6), round(corr(rmono, rp), 6), false, true FROM r
       UNION ALL SELECT 'neg', round(corr(neg, p), 6), round(corr(rneg, rp), 6), false, true FROM r
       UNION ALL SELECT 'q', round(corr(q, p), 6), round(corr(rq, rp), 6), false, false FROM r""",
)
def _redundant(spark, sf):
    p = F.col("l_extendedprice")
    df = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("q"),
        p.alias("p"),
        (3 * p + 10).alias("lin"),
        F.log1p(F.abs(p)).alias("mono"),
        (-F.sqrt(F.abs(p))).alias("neg"),
    )
    found = review.redundancy(df, [(f, "p") for f in ("lin", "mono", "neg", "q")])
    return found.select(
        "feature",
        F.round("correlation", 6).alias("correlation"),
        F.round("rank_correlation", 6).alias("rank_correlation"),
        "linear",
        "monotone",
    )


# streaming


def _streamed(spark, sf):
    """Totals of a log in which some runs have written lines twice, cut-off ones too; read in several batches."""
    log, out = new_path(spark, "log"), new_path(spark, "progress")
    rows = _log_rows(spark, sf)
    for part in (rows, rows.filter("split % 2 = 1")):
        runlog.append_log(part, log)
        _append_cut_lines(spark, sf, log)
    streaming.write_progress(streaming.log_stream(spark, log, files_per_batch=32), out).awaitTermination()
    return out


@book.query(
    "streaming_progress",
    f"""WITH {_CAND}, f AS (SELECT run_id, max(score) AS best_score, count(score) AS successes,
         count(*) - count(score) AS failures FROM c GROUP BY 1)
       SELECT f.*, (SELECT min(step) FROM c WHERE c.run_id = f.run_id AND c.score = f.best_score) AS best_step FROM f""",
)
def _streaming(spark, sf):
    """Repeated and malformed lines change no total."""
    return streaming.read_progress(spark, _streamed(spark, sf))


@book.query(
    "streaming_malformed",
    """SELECT event_type AS run_id, (user_id % 5)::INTEGER AS split, '{broken ' || event_id AS line
       FROM events WHERE user_id % 7 = 3""",
)
def _streaming_malformed(spark, sf):
    """Every malformed line is listed once, whatever batches it came in."""
    return streaming.read_malformed(spark, _streamed(spark, sf)).drop("batch")
