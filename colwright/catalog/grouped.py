"""Group statistics, frequencies, ranks and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from colwright.catalog.base import Book, table
from colwright.operators import groups, lookup, quantiles
from colwright.plans.spec import spec, with_features

book = Book()


def _stat(stat, sql_agg, by="event_type", x="value"):
    def run(spark, sf):
        df = groups.with_group_statistics(table(spark, sf, "events").select("event_id", by, x), [by], {"v": (stat, x)})
        return df.select("event_id", F.round("v", 6).alias("v"))

    book.add(
        f"group_{stat}",
        run,
        f"""WITH g AS (SELECT {by}, {sql_agg} AS v FROM events GROUP BY 1)
        SELECT event_id, round(v, 6) AS v FROM events LEFT JOIN g USING ({by})""",
    )


_stat("min", "min(value)")
_stat("max", "max(value)")
_stat("mean", "avg(value)")
_stat("median", "quantile_cont(value, 0.5)")
_stat("std", "stddev_samp(value)")


@book.query(
    "group_nunique",
    """WITH g AS (SELECT l_returnflag, count(DISTINCT l_suppkey) AS v FROM lineitem GROUP BY 1)
       SELECT l_orderkey, l_linenumber, v FROM lineitem JOIN g USING (l_returnflag)""",
)
def _nunique(spark, sf):
    df = table(spark, sf, "lineitem")
    out = groups.with_group_statistics(df, ["l_returnflag"], {"v": ("nunique", "l_suppkey")})
    return out.select("l_orderkey", "l_linenumber", "v")


@book.query(
    "group_statistics_null_keys",
    """WITH k AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS p, o_totalprice AS x
         FROM orders),
       g AS (SELECT p, avg(x) AS m, stddev_samp(x) AS sd, count(x) AS n FROM k WHERE p IS NOT NULL GROUP BY 1)
       SELECT o_orderkey, round(m, 4) AS m, round(sd, 4) AS sd, n FROM k LEFT JOIN g USING (p)""",
)
def _null_keys(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("p"),
        F.col("o_totalprice").alias("x"),
    )
    out = groups.with_group_statistics(df, ["p"], {"m": ("mean", "x"), "sd": ("std", "x"), "n": ("count", "x")})
    return out.select("o_orderkey", F.round("m", 4).alias("m"), F.round("sd", 4).alias("sd"), "n")


@book.query(
    "group_statistics_many_keys",
    """WITH k AS (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_linenumber END AS mode FROM lineitem),
       a AS (SELECT l_returnflag, avg(l_quantity) AS flag_mean, count(DISTINCT l_partkey) AS flag_parts FROM k GROUP BY 1),
       b AS (SELECT mode, max(l_extendedprice) AS mode_max, count(DISTINCT l_suppkey) AS mode_suppliers,
         count(DISTINCT l_returnflag) AS mode_flags FROM k WHERE mode IS NOT NULL GROUP BY 1),
       c AS (SELECT mode, l_returnflag, stddev_samp(l_quantity) AS both_std, median(l_quantity) AS both_median
         FROM k WHERE mode IS NOT NULL GROUP BY 1, 2),
       d AS (SELECT l_suppkey, count(l_discount) AS supplier_rows FROM k GROUP BY 1),
       e AS (SELECT l_linestatus, l_linenumber, min(l_tax) AS low_tax FROM k GROUP BY 1, 2)
       SELECT l_orderkey, l_linenumber, round(flag_mean, 6) AS flag_mean, flag_parts, mode_max, mode_suppliers, mode_flags,
         round(both_std, 6) AS both_std, both_median, supplier_rows, low_tax
       FROM k LEFT JOIN a USING (l_returnflag) LEFT JOIN b USING (mode) LEFT JOIN c USING (mode, l_returnflag)
         LEFT JOIN d USING (l_suppkey) LEFT JOIN e USING (l_linestatus, l_linenumber)""",
)
def _many_keys(spark, sf):
    """Five keys, two of them of two columns, from one scan for sums and one for distinct counts."""
    mode = F.when(F.col("l_linenumber") != 3, F.col("l_linenumber"))
    specs = [
        spec("group_mean", "l_returnflag", "l_quantity", name="flag_mean"),
        spec("group_nunique", "l_returnflag", "l_partkey", name="flag_parts"),
        spec("group_max", "mode", "l_extendedprice", name="mode_max"),
        spec("group_nunique", "mode", "l_suppkey", name="mode_suppliers"),
        spec("group_nunique", "mode", "l_returnflag", name="mode_flags"),
        spec("group_std", "mode", "l_returnflag", "l_quantity", name="both_std"),
        spec("group_median", "mode", "l_returnflag", "l_quantity", name="both_median"),
        spec("group_count", "l_suppkey", "l_discount", name="supplier_rows"),
        spec("group_min", "l_linestatus", "l_linenumber", "l_tax", name="low_tax"),
    ]
    out = with_features(table(spark, sf, "lineitem").withColumn("mode", mode), specs)
    rounded = [F.round(c, 6).alias(c) for c in ("flag_mean", "both_std")]
    exact = ["flag_parts", "mode_max", "mode_suppliers", "mode_flags", "both_median", "supplier_rows", "low_tax"]
    return out.select("l_orderkey", "l_linenumber", *rounded, *exact)


@book.query(
    "frequency",
    """WITH g AS (SELECT p_brand, count(*) / sum(count(*)) OVER () AS v FROM part GROUP BY 1)
       SELECT p_partkey, round(v, 6) AS v FROM part JOIN g USING (p_brand)""",
)
def _frequency(spark, sf):
    df = groups.with_frequency(table(spark, sf, "part"), "p_brand", "v")
    return df.select("p_partkey", F.round("v", 6).alias("v"))


@book.query(
    "value_count",
    """WITH g AS (SELECT l_quantity, count(*) AS v FROM lineitem GROUP BY 1)
       SELECT l_orderkey, l_linenumber, v FROM lineitem JOIN g USING (l_quantity)""",
)
def _value_count(spark, sf):
    df = groups.with_frequency(table(spark, sf, "lineitem"), "l_quantity", "v", relative=False)
    return df.select("l_orderkey", "l_linenumber", "v")


@book.query(
    "combined_frequency",
    """WITH g AS (SELECT l_returnflag, l_linestatus, count(*) / sum(count(*)) OVER () AS v FROM lineitem GROUP BY 1, 2)
       SELECT l_orderkey, l_linenumber, round(v, 6) AS v FROM lineitem JOIN g USING (l_returnflag, l_linestatus)""",
)
def _combined_frequency(spark, sf):
    df = groups.with_combined_frequency(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "v")
    return df.select("l_orderkey", "l_linenumber", F.round("v", 6).alias("v"))


@book.query(
    "residual",
    "SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 6) AS v FROM customer",
)
def _residual(spark, sf):
    df = groups.with_residual(table(spark, sf, "customer"), "c_acctbal", "v")
    return df.select("c_custkey", F.round("v", 6).alias("v"))


@book.query(
    "group_deviation",
    """WITH g AS (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY 1)
       SELECT c_custkey, round(c_acctbal - m, 6) AS v FROM customer JOIN g USING (c_mktsegment)""",
)
def _group_deviation(spark, sf):
    df = groups.with_group_deviation(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", "v")
    return df.select("c_custkey", F.round("v", 6).alias("v"))


@book.query(
    "group_mean_fitted",
    """WITH g AS (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer WHERE c_nationkey < 20 GROUP BY 1)
       SELECT c_custkey, round(m, 6) AS v FROM customer LEFT JOIN g USING (c_mktsegment)""",
)
def _group_mean_fitted(spark, sf):
    """Statistics learned from some rows only and applied to all."""
    df = table(spark, sf, "customer")
    out = groups.with_group_statistics(
        df, ["c_mktsegment"], {"v": ("mean", "c_acctbal")}, fit_on=F.col("c_nationkey") < 20
    )
    return out.select("c_custkey", F.round("v", 6).alias("v"))


_RANK_SQL = """SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
    + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS v FROM lineitem"""


@book.query("group_rank", _RANK_SQL)
def _group_rank(spark, sf):
    df = quantiles.group_rank(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "v")
    return df.select("l_orderkey", "l_linenumber", "v")


@book.query(
    "group_rank_blocks",
    """SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)
    + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS v FROM lineitem""",
)
def _group_rank_blocks(spark, sf):
    """Ranks of large groups: running counts over blocks with carries."""
    df = quantiles.group_rank(
        table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "v", key_rows=0, block_rows=5_000
    )
    return df.select("l_orderkey", "l_linenumber", "v")


@book.query("distinct_values", "SELECT DISTINCT o_orderpriority AS label FROM orders")
def _distinct(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("label")).distinct()


@book.query(
    "lookup_codes",
    """WITH k AS (SELECT o_orderpriority AS value, (row_number() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS code
         FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH'))
       SELECT o_orderkey, coalesce(code, -1) AS v FROM orders LEFT JOIN k ON o_orderpriority = value""",
)
def _lookup_codes(spark, sf):
    from colwright.operators.encode import category_codes

    df = table(spark, sf, "orders")
    seen = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "2-HIGH")
    return lookup.map_codes(df, category_codes(df, "o_orderpriority", seen), "o_orderpriority", "v").select(
        "o_orderkey", "v"
    )


@book.query(
    "unseen_values",
    """SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey NOT IN
       (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40 AND l_discount > 0.09)""",
)
def _unseen(spark, sf):
    df = table(spark, sf, "lineitem")
    train = df.filter((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40) & (F.col("l_discount") > 0.09))
    return lookup.unseen_values(df.filter(F.col("l_returnflag") == "R"), train, "l_suppkey")


@book.query(
    "describe_columns",
    """WITH c AS (SELECT DISTINCT p_type || '_' || p_brand AS name, p_type, p_brand FROM part)
       SELECT name, CASE WHEN p_type = 'ECONOMY' THEN 'cheap (brand ' || p_brand || ')'
         WHEN p_type = 'SMALL' THEN 'brand ' || p_brand ELSE replace(name, '_', ' ') END AS description FROM c""",
)
def _describe(spark, sf):
    parts = table(spark, sf, "part").select(F.concat_ws("_", "p_type", "p_brand").alias("name"), "p_type", "p_brand")
    known = parts.distinct().filter(F.col("p_type").isin("ECONOMY", "SMALL"))
    metadata = known.select(
        "name",
        F.lit(None).cast("string").alias("type"),
        F.when(F.col("p_type") == "ECONOMY", F.lit("cheap")).otherwise(F.lit("")).alias("description"),
        F.concat(F.lit("brand "), "p_brand").alias("context"),
    )
    return lookup.describe_columns(parts.select("name").distinct(), metadata).select("name", "description")


@book.query(
    "positional_join",
    "SELECT c_custkey, c_acctbal, c_mktsegment AS target FROM customer",
)
def _positional(spark, sf):
    """Features and target that were split are joined again by row id."""
    df = table(spark, sf, "customer")
    features, target = df.select("c_custkey", "c_acctbal"), df.select("c_custkey", F.col("c_mktsegment").alias("target"))
    return features.join(target, "c_custkey")
