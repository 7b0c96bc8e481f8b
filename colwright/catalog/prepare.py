"""Reading, describing, encoding and splitting tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colwright.catalog.base import Book, table
from colwright.operators import encode, folds, profile
from colwright.sources import metadata, tables
from colwright.storage import new_path

book = Book()


@book.query("csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _csv(spark, sf):
    df = table(spark, sf, "customer")
    path = new_path(spark, "csv")
    df.write.option("header", True).csv(path)
    return tables.read_csv(spark, path, df.schema)


@book.query("csv_scan_inferred", "SELECT c_custkey::INTEGER AS c_custkey, c_name, c_acctbal FROM customer")
def _csv_inferred(spark, sf):
    path = new_path(spark, "csv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path)
    return tables.read_csv(spark, path)


@book.query(
    "flat_metadata",
    """SELECT p_partkey, name, NULL::VARCHAR AS type, description FROM (
         SELECT p_partkey, p_name AS name, 'type ' || p_type AS description FROM part
         UNION ALL SELECT p_partkey, 'brand', p_brand FROM part)""",
)
def _flat(spark, sf):
    document = F.to_json(
        F.map_from_entries(
            F.array(
                F.struct(F.col("p_name").alias("k"), F.concat(F.lit("type "), "p_type").alias("v")),
                F.struct(F.lit("brand").alias("k"), F.col("p_brand").alias("v")),
            )
        )
    )
    docs = table(spark, sf, "part").select("p_partkey", document.alias("doc"))
    return metadata.flat_metadata(docs, "doc", "p_partkey").select("p_partkey", "name", "type", "description")


@book.query(
    "structured_metadata",
    """SELECT p_partkey, p_name AS name, 'continuous' AS type, p_type AS description, '' AS context, NULL::VARCHAR AS note
         FROM part
       UNION ALL SELECT p_partkey, p_brand, CASE WHEN p_size > 25 THEN 'binary' ELSE 'categorical' END, '',
         'size ' || p_size, NULL FROM part
       UNION ALL SELECT p_partkey, 'date', 'datetime', '', '', p_brand FROM part""",
)
def _structured(spark, sf):
    # the unnamed entry is skipped, and missing types take the default of their list
    document = F.to_json(
        F.struct(
            F.array(
                F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("description")),
                F.struct(F.lit("").alias("name"), F.lit("unnamed").alias("description")),
            ).alias("continuous_features"),
            F.array(
                F.struct(
                    F.col("p_brand").alias("name"),
                    F.when(F.col("p_size") > 25, F.lit("binary")).alias("type"),
                    F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("context"),
                )
            ).alias("categorical_features"),
            F.array(F.struct(F.lit("date").alias("name"), F.col("p_brand").alias("note"))).alias("temporal_features"),
        )
    )
    docs = table(spark, sf, "part").select("p_partkey", document.alias("doc"))
    return metadata.metadata_rows(docs, "doc", "p_partkey")


def _stray(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_totalprice").alias("Unnamed: 0"),
        F.col("o_orderdate").alias("date"),
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
    )


@book.query("split_features", "SELECT o_orderkey, o_custkey FROM orders")
def _split(spark, sf):
    features, _ = tables.split_features(tables.drop_stray_columns(_stray(spark, sf)))
    return features


@book.query("split_target", "SELECT o_orderstatus FROM orders")
def _target(spark, sf):
    _, target = tables.split_features(_stray(spark, sf))
    return target


@book.query("as_doubles", "SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, o_totalprice FROM orders")
def _doubles(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return tables.as_doubles(df, ["o_orderkey"])


# profiles


def _label(spark, sf):
    flag = (F.col("l_returnflag") == "R").cast("int").alias("returned")
    return table(spark, sf, "lineitem").select("l_quantity", "l_linenumber", "l_returnflag", "l_shipdate", flag)


_LABEL_SQL = "l AS (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS returned FROM lineitem)"


_KIND_COLUMNS = ("l_quantity", "l_linenumber", "l_returnflag", "l_shipdate", "returned")
_HINTS = (("l_linenumber", "Ordinal"), ("returned", "numerical"), ("l_quantity", "unknown"))


def _kind_sql(column, hints=()):
    """A row (name, kind, n_known, high) whose kind follows from the hint, else from the column's type and values."""
    hint = dict(hints).get(column, "").lower()
    number = f"typeof(any_value({column})) IN ('DOUBLE', 'FLOAT', 'BIGINT', 'INTEGER')"
    zero_one = f"coalesce(bool_and({column}::VARCHAR IN ('0', '1')) AND count(DISTINCT {column}) = 2 AND count({column}) = count(*), false)"
    return f"""SELECT '{column}' AS name, CASE WHEN '{hint}' IN ('categorical', 'binary', 'ordinal') THEN 'categorical'
      WHEN '{hint}' IN ('continuous', 'numeric', 'numerical') THEN 'numeric'
      WHEN {number} AND NOT {zero_one} THEN 'numeric' ELSE 'categorical' END AS kind, count({column}) AS n_known,
      CASE WHEN {number} THEN max(try_cast({column}::VARCHAR AS DOUBLE)) END AS high FROM l"""


@book.query(
    "column_kinds",
    f"WITH {_LABEL_SQL} SELECT name, kind, n_known FROM ({' UNION ALL '.join(_kind_sql(c) for c in _KIND_COLUMNS)})",
)
def _kinds(spark, sf):
    return profile.infer_kinds(profile.column_statistics(_label(spark, sf))).select("name", "kind", "n_known")


@book.query(
    "column_kinds_hinted",
    f"WITH {_LABEL_SQL} SELECT name, kind, high FROM ({' UNION ALL '.join(_kind_sql(c, _HINTS) for c in _KIND_COLUMNS)})",
)
def _kinds_hinted(spark, sf):
    hints = spark.createDataFrame(_HINTS, "name string, type string")
    kinds = profile.infer_kinds(profile.column_statistics(_label(spark, sf)), hints)
    return kinds.select("name", "kind", "high")


@book.query(
    "column_ranges",
    """SELECT 'l_quantity' AS name, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem
       UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem
       UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount) FROM lineitem
       UNION ALL SELECT 'l_suppkey', min(l_suppkey), max(l_suppkey) FROM lineitem""",
)
def _ranges(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_suppkey")
    return profile.column_statistics(df).select("name", "low", "high")


def _listed(columns, source):
    """SQL for the distinct values of columns as rows (name, position, value)."""
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS name, row_number() OVER (ORDER BY v) AS position, v AS value
            FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM {source} WHERE {c} IS NOT NULL)"""
        for c in columns
    )


@book.query("category_lists", _listed(["p_brand", "p_type", "p_partkey"], "part"))
def _categories(spark, sf):
    return profile.category_lists(table(spark, sf, "part"), ["p_brand", "p_type", "p_partkey"])


@book.query(
    "category_values",
    """SELECT DISTINCT 'o_orderpriority' AS name, o_orderpriority AS value FROM orders
       UNION ALL SELECT DISTINCT 'o_custkey', o_custkey::VARCHAR FROM orders""",
)
def _category_values(spark, sf):
    return profile.category_values(table(spark, sf, "orders"), ["o_orderpriority", "o_custkey"])


@book.query(
    "profile_lines",
    f"""SELECT 'o_custkey' AS name, 'numeric' AS kind, 0 AS position,
         '- o_custkey: o custkey (numerical variable within range [' || min(o_custkey) || ', ' || max(o_custkey) || '])'
         AS line FROM orders
       UNION ALL SELECT 'o_totalprice', 'numeric', 0, '- o_totalprice: Price of the order (in dollars) (numerical '
         || 'variable within range [' || min(o_totalprice) || ', ' || max(o_totalprice) || '])' FROM orders
       UNION ALL SELECT 'o_orderpriority', 'categorical', 0,
         '- o_orderpriority: Urgency (categorical variable with categories)'
       UNION ALL SELECT 'o_orderdate', 'categorical', 0, '- o_orderdate: o orderdate (categorical variable with categories)'
       UNION ALL SELECT name, 'categorical', position, value FROM ({_listed(["o_orderpriority", "o_orderdate"], "orders")})""",
)
def _profile(spark, sf):
    told = spark.createDataFrame(
        [
            ("o_totalprice", "continuous", "Price of the order", "in dollars"),
            ("o_orderpriority", "categorical", "", "Urgency"),
        ],
        "name string, type string, description string, context string",
    )
    df = table(spark, sf, "orders").drop("o_orderkey")
    lines = profile.profile_lines(df, told, target="o_orderstatus")
    return lines.select("name", "kind", "position", "line")


# codes


@book.query(
    "label_encode",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 5 ELSE
         (dense_rank() OVER (ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END NULLS LAST) - 1) END::INTEGER
         AS v FROM orders""",
)
def _label_encode(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("p")
    )
    return encode.label_encode(df, "p", "v").select("o_orderkey", "v")


@book.query(
    "label_encode_target",
    "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INTEGER AS y FROM orders",
)
def _label_target(spark, sf):
    return encode.label_encode(table(spark, sf, "orders"), "o_orderstatus", "y").select("o_orderkey", "y")


@book.query(
    "code_mappings",
    """SELECT 'o_orderstatus' AS name, v AS value, (row_number() OVER (ORDER BY v) - 1)::INTEGER AS code
         FROM (SELECT DISTINCT o_orderstatus AS v FROM orders WHERE o_custkey > 100)
       UNION ALL SELECT 'o_orderpriority', v, (row_number() OVER (ORDER BY v) - 1)::INTEGER
         FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_custkey > 100)""",
)
def _mappings(spark, sf):
    mappings = encode.fit_mappings(
        table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], F.col("o_custkey") > 100
    )
    return encode.mapping_table(mappings)


_MODEL_SQL = """k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
    FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'
      AND o_orderpriority <> '5-LOW')),
  m AS (SELECT o_orderkey, o_orderdate, coalesce(code, -1)::DOUBLE AS o_orderpriority,
    CASE WHEN o_totalprice > 5000 THEN o_totalprice END AS x FROM orders LEFT JOIN k ON v = o_orderpriority)"""


def _model_input(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderdate",
        "o_orderpriority",
        F.when(price > 5000, price).otherwise(F.lit(float("inf"))).alias("x"),
    )


@book.query("model_table", f"WITH {_MODEL_SQL} SELECT o_orderkey, o_orderpriority, x FROM m")
def _model(spark, sf):
    df = _model_input(spark, sf)
    early = (F.col("o_orderdate") < "1995-01-01") & (F.col("o_orderpriority") != "5-LOW")
    mappings = encode.fit_mappings(df, ["o_orderpriority"], early)
    return encode.model_table(df.drop("o_orderdate"), mappings, ["o_orderkey"])


@book.query(
    "train_test_tables",
    """WITH k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
         FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_custkey < 4))
       SELECT o_orderkey, coalesce(code, -1)::DOUBLE AS o_orderpriority, o_totalprice,
         o_custkey < 4 AS is_train FROM orders LEFT JOIN k ON v = o_orderpriority""",
)
def _train_test(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    train, test, _ = encode.train_test_tables(df, F.col("o_custkey") < 4, ["o_orderkey", "o_custkey"])
    both = train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))
    return both.drop("o_custkey")


@book.query(
    "impute_for_trees",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -999 END AS x,
         CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS x__missing FROM orders""",
)
def _impute(spark, sf):
    gaps = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("x")
    df, _ = encode.impute_for_trees(table(spark, sf, "orders").select("o_orderkey", gaps), ["x"])
    return df


# folds


@book.query(
    "stratified_folds",
    """SELECT event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY md5('42~' || event_id)) - 1) % 5)::INTEGER
       AS fold FROM events""",
)
def _stratified(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type")
    return folds.stratified_folds(df, "event_type", ["event_id"], 5).select("event_id", "fold")


@book.query(
    "shuffled_folds",
    "SELECT event_id, ((row_number() OVER (ORDER BY md5('42~' || event_id)) - 1) % 4)::INTEGER AS fold FROM events",
)
def _shuffled(spark, sf):
    return folds.shuffled_folds(table(spark, sf, "events").select("event_id"), ["event_id"], 4)


_TIME_SQL = """t AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n
    FROM events),
  f AS (SELECT event_id, CASE WHEN i < n - 4 * (n // 5) THEN -1 ELSE (i - (n - 4 * (n // 5))) // (n // 5) END::INTEGER
    AS fold FROM t)"""


@book.query("time_folds", f"WITH {_TIME_SQL} SELECT event_id, fold FROM f")
def _time(spark, sf):
    return folds.time_folds(table(spark, sf, "events").select("ts", "event_id"), ["ts", "event_id"], 4).select(
        "event_id", "fold"
    )


@book.query("fold_train_rows", f"WITH {_TIME_SQL} SELECT event_id FROM f WHERE fold < 2")
def _fold_rows(spark, sf):
    df = folds.time_folds(table(spark, sf, "events").select("ts", "event_id"), ["ts", "event_id"], 4)
    return df.filter(folds.is_train(F.col("fold"), 2, ordered=True)).select("event_id")


@book.query(
    "sample_rows", "SELECT event_id, event_type, value FROM events ORDER BY md5('42~' || event_id) LIMIT 10"
)
def _sample(spark, sf):
    return folds.sample_rows(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_id"], 10)
