"""Row-wise numbers, dates and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from colwright.catalog.base import Book, table
from colwright.functions import custom, dates, numeric as num, text
from colwright.operators import groups, quantiles
from colwright.plans.spec import spec, with_features
from colwright.sources import tables

book = Book()


def _rounded(column, digits=6):
    return F.round(column, digits)


def _over(name, source, keys, column, sql_column, where_sql=""):
    """A query that adds one computed column ``v`` to the keys of a table."""
    key_sql = ", ".join(keys)
    book.add(
        name,
        lambda spark, sf: table(spark, sf, source).select(*keys, column().alias("v")),
        f"SELECT {key_sql}, {sql_column} AS v FROM {source} {where_sql}",
    )


_C = ("customer", ["c_custkey"])
_L = ("lineitem", ["l_orderkey", "l_linenumber"])
_O = ("orders", ["o_orderkey"])


def _acct():
    return F.col("c_acctbal")


def _small():
    return F.col("c_acctbal") / 1000


_over("absolute", *_C, lambda: num.absolute(_acct()), "abs(c_acctbal)")
_over("log_safe", *_C, lambda: _rounded(num.log_safe(_acct())), "round(ln(1 + abs(c_acctbal)), 6)")
_over(
    "log_plain",
    *_C,
    lambda: _rounded(num.log_plain(_acct())),
    "CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END",
)
_over("sqrt_abs", *_C, lambda: _rounded(num.sqrt_abs(_acct())), "round(sqrt(abs(c_acctbal)), 6)")
_over(
    "sqrt_signed",
    *_C,
    lambda: _rounded(num.sqrt_signed(_acct())),
    "round(sqrt(abs(c_acctbal)) * sign(c_acctbal), 6)",
)
_over("sigmoid", *_C, lambda: _rounded(num.sigmoid(_small())), "round(1 / (1 + exp(-c_acctbal / 1000)), 6)")
_over("square", *_C, lambda: _rounded(num.square(_small())), "round((c_acctbal / 1000) * (c_acctbal / 1000), 6)")
_over("power", *_C, lambda: _rounded(num.power(_small(), 3)), "round(pow(c_acctbal / 1000, 3), 6)")
_over(
    "round_half_even",
    *_L,
    lambda: num.round_half_even(F.col("l_extendedprice") * F.col("l_discount")),
    "round_even(l_extendedprice * l_discount * 100, 0) / 100",
)
_over(
    "minimum",
    *_L,
    lambda: num.minimum(F.col("l_quantity"), F.col("l_suppkey")),
    "CASE WHEN l_quantity IS NOT NULL AND l_suppkey IS NOT NULL THEN least(l_quantity, l_suppkey::DOUBLE) END",
)
_over(
    "maximum",
    *_L,
    lambda: num.maximum(F.col("l_quantity"), F.col("l_suppkey")),
    "CASE WHEN l_quantity IS NOT NULL AND l_suppkey IS NOT NULL THEN greatest(l_quantity, l_suppkey::DOUBLE) END",
)
_over(
    "arithmetic",
    *_L,
    lambda: _rounded(
        num.ratio(num.subtract(num.add(F.col("l_quantity"), F.col("l_tax")), F.col("l_discount")), F.col("l_linenumber")) * 2
    ),
    "round((l_quantity + l_tax - l_discount) / nullif(l_linenumber, 0) * 2, 6)",
)
_over(
    "product_interaction",
    *_L,
    lambda: num.product(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), scale=1e6),
    "l_quantity * l_extendedprice * l_discount / 1000000",
)
_over(
    "absolute_difference",
    *_L,
    lambda: _rounded(num.absolute_difference(F.col("l_quantity"), F.col("l_linenumber"))),
    "round(abs(l_quantity - l_linenumber), 6)",
)
_over(
    "row_sum",
    *_L,
    lambda: _rounded(num.row_sum(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_suppkey"))),
    "round(l_quantity + l_linenumber + l_suppkey, 6)",
)
_over(
    "row_mean",
    *_L,
    lambda: _rounded(num.row_mean(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_suppkey"))),
    "round((l_quantity + l_linenumber + l_suppkey) / 3, 6)",
)
_over(
    "ratio",
    *_L,
    lambda: _rounded(num.ratio(F.col("l_extendedprice"), F.col("l_tax"))),
    "round(l_extendedprice / nullif(l_tax, 0), 6)",
)
_over(
    "ratio_guarded",
    *_L,
    lambda: _rounded(num.ratio_guarded(F.col("l_extendedprice"), F.col("l_tax"))),
    "round(l_extendedprice / CASE WHEN l_tax = 0 THEN 1 ELSE l_tax END, 6)",
)
_over(
    "conditional",
    *_L,
    lambda: num.where(F.col("l_quantity") > 25, F.col("l_extendedprice"), F.col("l_tax")),
    "CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE l_tax END",
)
_over(
    "binary_flag",
    *_L,
    lambda: num.flag((F.col("l_discount") > 0.05) & (F.col("l_returnflag") == "R")),
    "CAST(l_discount > 0.05 AND l_returnflag = 'R' AS INTEGER)",
)
_over("clip", *_C, lambda: num.clip(_acct(), 0, 5000), "least(greatest(c_acctbal, 0), 5000)")
_over(
    "fixed_edges",
    *_L,
    lambda: num.discretize(
        F.col("l_quantity") * 2, [24, 49, 50, 75, 100], ["Extreme Fear", "Fear", "Neutral", "Greed", "Extreme Greed"]
    ),
    """CASE WHEN l_quantity * 2 <= 24 THEN 'Extreme Fear' WHEN l_quantity * 2 <= 49 THEN 'Fear'
       WHEN l_quantity * 2 <= 50 THEN 'Neutral' WHEN l_quantity * 2 <= 75 THEN 'Greed'
       WHEN l_quantity * 2 <= 100 THEN 'Extreme Greed' END""",
)
_over(
    "affine_scale",
    *_C,
    lambda: _rounded(num.scale_range(_acct(), -1000, 10000)),
    "round((c_acctbal + 1000) / 11000, 6)",
)
_over(
    "affine_unscale",
    *_C,
    lambda: _rounded(num.unscale_range(num.scale_range(_acct(), -1000, 10000), -8, 39), 4),
    "round((c_acctbal + 1000) / 11000 * 47 - 8, 4)",
)
_over("cast_double", *_L, lambda: F.col("l_partkey").cast("double"), "l_partkey::DOUBLE")


@book.query(
    "range_scaled",
    """SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS v
       FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""",
)
def _range_scaled(spark, sf):
    df = groups.with_range_scaled(table(spark, sf, "customer"), "c_acctbal", "v")
    return df.select("c_custkey", F.round("v", 6).alias("v"))


@book.query(
    "infinite_to_null",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS v FROM orders",
)
def _infinite_to_null(spark, sf):
    dirty = (
        F.when(F.col("o_orderstatus") == "O", F.lit(float("inf")))
        .when(F.col("o_orderstatus") == "P", F.lit(float("nan")))
        .otherwise(F.col("o_totalprice"))
    )
    return tables.clean(table(spark, sf, "orders").select("o_orderkey", dirty.alias("v")))


@book.query(
    "null_to_zero",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS v FROM orders",
)
def _null_to_zero(spark, sf):
    gaps = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return tables.fill_missing(table(spark, sf, "orders").select("o_orderkey", gaps.alias("v")))


@book.query(
    "quantile_bins",
    """WITH e AS (SELECT quantile_cont(l_extendedprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM lineitem)
       SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice <= q[2] THEN 0 WHEN l_extendedprice <= q[3] THEN 1
         WHEN l_extendedprice <= q[4] THEN 2 WHEN l_extendedprice <= q[5] THEN 3 ELSE 4 END AS v
       FROM lineitem, e""",
)
def _quantile_bins(spark, sf):
    df = quantiles.quantile_bins(table(spark, sf, "lineitem"), "l_extendedprice", 5, "v")
    return df.select("l_orderkey", "l_linenumber", "v")


@book.query(
    "exact_quantiles_bracketed",
    """SELECT l_returnflag, round(q[1], 6) AS q05, round(q[2], 6) AS q50, round(q[3], 6) AS q95 FROM
       (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.05, 0.5, 0.95]) AS q FROM lineitem GROUP BY 1)""",
)
def _exact_quantiles(spark, sf):
    """The sketch-and-bracket way, forced for every group."""
    q = quantiles.exact_quantiles(
        table(spark, sf, "lineitem"), "l_extendedprice", [0.05, 0.5, 0.95], ["l_returnflag"], group_values=0, accuracy=500
    )
    names = ("q05", "q50", "q95")
    return q.select("l_returnflag", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(names)])


# dates
_over("day_of_week", *_O, lambda: dates.day_of_week(F.col("o_orderdate")), "CAST(dayofweek(o_orderdate) + 1 AS INTEGER)")
_over("month", *_O, lambda: dates.month(F.col("o_orderdate")), "CAST(month(o_orderdate) AS INTEGER)")
_over("quarter", *_O, lambda: dates.quarter(F.col("o_orderdate")), "CAST(quarter(o_orderdate) AS INTEGER)")
_over("year", *_O, lambda: dates.year(F.col("o_orderdate")), "CAST(year(o_orderdate) AS INTEGER)")
_over(
    "days_since",
    *_O,
    lambda: dates.days_since(F.col("o_orderdate"), "1997-03-15"),
    "CAST(date_diff('day', DATE '1997-03-15', o_orderdate::DATE) AS INTEGER)",
)
_over(
    "days_since_latest",
    *_O,
    lambda: dates.days_since_latest(F.col("o_orderdate"), ["1993-11-28", "1996-07-09", "1997-05-11"]),
    """CAST(CASE WHEN o_orderdate::DATE >= DATE '1997-05-11' THEN date_diff('day', DATE '1997-05-11', o_orderdate::DATE)
       WHEN o_orderdate::DATE >= DATE '1996-07-09' THEN date_diff('day', DATE '1996-07-09', o_orderdate::DATE)
       WHEN o_orderdate::DATE >= DATE '1993-11-28' THEN date_diff('day', DATE '1993-11-28', o_orderdate::DATE)
       END AS INTEGER)""",
)
_over(
    "cyclic_month",
    *_O,
    lambda: _rounded(
        dates.cyclic_sin(F.month("o_orderdate"), 12) + 2 * dates.cyclic_cos(F.month("o_orderdate"), 12)
    ),
    "round(sin(month(o_orderdate) * 2 * pi() / 12) + 2 * cos(month(o_orderdate) * 2 * pi() / 12), 6)",
)
_over(
    "magnitude_suffix",
    *_O,
    lambda: _rounded(
        dates.parse_magnitude(
            F.concat(
                F.col("o_custkey").cast("string"),
                F.when(F.col("o_orderstatus") == "F", F.lit("K"))
                .when(F.col("o_orderstatus") == "O", F.lit(" m"))
                .otherwise(F.lit(" units")),
            )
        )
    ),
    "CASE o_orderstatus WHEN 'F' THEN o_custkey * 1000.0::DOUBLE WHEN 'O' THEN o_custkey * 1000000.0::DOUBLE END",
)


# text
_over(
    "combine_categories",
    *_L,
    lambda: text.combine(F.col("l_returnflag"), F.when(F.col("l_linestatus") == "F", F.col("l_linestatus"))),
    "l_returnflag || '_' || CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'nan' END",
)
_over(
    "recode",
    *_L,
    lambda: text.recode(F.col("l_returnflag"), {"R": "x", "A": "o"}, "b"),
    "CASE l_returnflag WHEN 'R' THEN 'x' WHEN 'A' THEN 'o' ELSE 'b' END",
)
_over(
    "row_sentence",
    *_C,
    lambda: text.row_sentence(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]),
    """'If c_custkey is ' || c_custkey || ', c_name is ' || c_name || ', c_nationkey is ' || c_nationkey ||
       ',  Then c_mktsegment is ' || c_mktsegment || '.'""",
)


# chains of operators
@book.query(
    "operator_chain",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag, ln(1 + abs(l_extendedprice)) AS x FROM lineitem),
       g AS (SELECT l_returnflag, avg(x) AS m FROM a GROUP BY 1)
       SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-m)), 6) AS v, round(x - m, 6) AS d
       FROM a JOIN g USING (l_returnflag)""",
)
def _operator_chain(spark, sf):
    inner = spec("log_safe", "l_extendedprice")
    mean = spec("group_mean", "l_returnflag", inner)
    chained = [spec("sigmoid", mean, name="v"), spec("subtract", inner, mean, name="d")]
    df = with_features(table(spark, sf, "lineitem"), chained)
    return df.select("l_orderkey", "l_linenumber", F.round("v", 6).alias("v"), F.round("d", 6).alias("d"))


@book.query(
    "table_function",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue
       FROM lineitem""",
)
def _table_function(spark, sf):
    """A feature function from table to table, as users write them."""

    def revenue(df):
        net = num.product(F.col("l_extendedprice"), 1 - F.col("l_discount"))
        return df.withColumn("revenue", F.round(net, 4))

    return table(spark, sf, "lineitem").transform(revenue).select("l_orderkey", "l_linenumber", "revenue")


@book.query(
    "row_function",
    "SELECT p_partkey, CASE WHEN length(p_name) % 2 = 0 THEN 'even ' || upper(p_name) ELSE p_name END AS v FROM part",
)
def _row_function(spark, sf):
    """A Python function of one value, run on Arrow batches."""
    name = custom.row_function(lambda v: f"even {v.upper()}" if len(v) % 2 == 0 else v, "string")
    return table(spark, sf, "part").select("p_partkey", name("p_name").alias("v"))
