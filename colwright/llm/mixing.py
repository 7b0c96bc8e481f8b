"""Mixing sources to target weights along a curriculum that changes over time.

Each source has a target number of words (water filling: shares by weight, no source above ``cap`` times its size) and a
weight schedule over training time. The integral of its schedule says which part of its target is due by time ``t``;
inverted, it gives every word of the source its time. Documents of a source are laid end to end in the order of a digest
of their id, once per pass, up to the target; a document's position is the inverted demand at its first word, and the mix
is the table sorted by range on that position.

A source may hold a large part of all rows. Its running sums are therefore taken over hash blocks: the digest cuts every
source into even blocks, block totals give the offsets, and a window runs inside one block only. The number of blocks
follows the size of the largest source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colwright.storage import cut_lineage

#: A source is taken at most so many times.
CAP = 3
#: Rows of a source that one window task orders, about.
BLOCK_ROWS = 20_000
#: Curriculum: at the end of training a source is this many times as likely as at its start; cycled over the sources.
#: The schedule is linear in between, so its integral and the inverse have closed forms.
SLOPES = (0.5, 1.0, 2.0)

# Fixed value: a word is a run of characters other than ASCII white space.
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Per source (one row each in ``sizes``: source, source_size): weight, target in words, and ``slope``.

    Sources are ordered by code point, NULL last, and weigh ``weights`` in turn. The targets share all words by weight; a
    target stops at ``cap`` times its source and the excess goes to the others by weight, until none is above. That is
    one level ``v`` for all: target = min(cap * size, v * weight), found from running sums over the sources.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(by_name) - 1
    cycle = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("place"), F.lit(len(values))) + 1).cast("int"))
    named = sizes.withColumn("place", place).withColumns({"weight": cycle(weights).cast("long"), "slope": cycle(SLOPES)})
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("place"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    fits = F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"), F.col("level"))
    first = F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("v") * F.col("weight"), (cap * F.col("source_size")).cast("double"))
    return named.withColumn("level", level).withColumn("v", first).select("source", "source_size", "weight", "slope", target.alias("target"))


def when_due(part: Column, slope: Column) -> Column:
    """The time in [0, 1] by which a source has given ``part`` of its target.

    The schedule is w(t) = 1 + (slope - 1) t; its integral over [0, t], divided by that over [0, 1], is ``part``. Solved for t.
    """
    a = (slope - 1) / 2
    root = (F.sqrt(1 + 4 * a * part * (1 + a)) - 1) / (2 * a) + F.lit(0.0)  # no negative zero
    return F.when(F.abs(a) < 1e-12, part).otherwise(root)


def assign(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = CAP,
    carry: tuple[str, ...] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per row of ``df``: its size, its source's size and target, ``taken`` words, and ``copies``.

    ``copies`` has (pass, position, words) of each time the mix takes the document: whole, or cut at the target for the
    last document of a source, so that a source gives its target rounded down. NULL and empty texts have size 0 and are
    never taken. Rows of equal id and text are separate documents; their order among themselves does not show. A NULL
    source is a source of its own, sorted last. ``carry`` names further (small) columns to hand through.
    """
    slim = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`").cast("string")).alias("size"),
        F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")).alias("digest"),
        *[F.col(f"`{c}`").alias(f"__carry_{i}") for i, c in enumerate(carry)],
    )
    sized = cut_lineage(slim, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    totals = cut_lineage(totals, "sources")
    targets = cut_lineage(source_targets(totals.select("source", "source_size"), weights, cap), "targets")
    largest = totals.agg(F.max("n")).first()[0] or 0
    hex_digits = 1
    while largest > block_rows * 16**hex_digits:
        hex_digits += 1
    blocked = sized.withColumn("block", F.substring("digest", 1, hex_digits))
    sums = blocked.groupBy("source", "block").agg(F.sum("size").alias("words"))
    # one row per source and block: rows / BLOCK_ROWS at most, times 16
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(sums.select("source", "block", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")), "starts")
    known = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(starts["source"].alias("s"), starts["block"].alias("b"), "start", "source_size", "target", "slope")
    known = cut_lineage(known, "known")
    inside = Window.partitionBy("source", "block").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(known, placed["source"].eqNullSafe(known["s"]) & (placed["block"] == known["b"]))
    at = F.col("start") + F.col("inner")
    goal = F.floor("target")
    whole = F.transform(
        F.sequence(F.lit(0), F.lit(cap - 1)),
        lambda p: F.struct(
            p.alias("pass"),
            when_due((p * F.col("source_size") + at) / F.nullif("target", F.lit(0.0)), F.col("slope")).alias("position"),
            F.greatest(F.lit(0), F.least(F.col("size"), goal - p * F.col("source_size") - at)).cast("long").alias("words"),
        ),
    )
    copies = F.filter(whole, lambda c: c["words"] > 0)
    out = placed.select("doc_id", "source", "size", "source_size", "target", "digest", copies.alias("copies"), *[f"__carry_{i}" for i in range(len(carry))])
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return out.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "digest", "copies",
        *[F.col(f"__carry_{i}") for i in range(len(carry))],
    )


def training_order(assigned: DataFrame) -> DataFrame:
    """One row per taken copy, sorted by range on its position; ties by digest, then pass."""
    mixed = assigned.withColumn("copy", F.explode("copies")).select("*", "copy.*").drop("copy", "copies")
    return mixed.orderBy("position", "digest", "pass")


def mix_summary(assigned: DataFrame) -> DataFrame:
    """Per document what the mix takes of it, sorted by range on the position of its first copy (never taken: last)."""
    first = F.when(F.size("copies") > 0, F.element_at("copies", 1)["position"])
    out = assigned.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"), "digest")
    return out.orderBy(F.col("position").asc_nulls_last(), "digest").drop("digest")


SQL = """
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '')) AS digest
    FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (
    SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS weight,
        [0.5::DOUBLE, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS slope
    FROM totals),
levels AS (
    SELECT *, row_number() OVER w AS k,
        (sum(source_size) OVER ()
         - 3 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
    FROM named WINDOW w AS (ORDER BY source_size / weight, source IS NULL, source)),
chosen AS (SELECT level AS v FROM levels WHERE level * weight <= 3 * source_size ORDER BY k LIMIT 1),
targets AS (
    SELECT source, source_size, slope, least(v * weight, (3 * source_size)::DOUBLE) AS target FROM levels LEFT JOIN chosen ON true),
placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, t.slope,
        (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS start
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
due AS (
    SELECT *, [greatest(0, least(size, floor(target)::BIGINT - p * source_size - start)) FOR p IN [0, 1, 2]] AS words,
        start / target AS part, (slope - 1) / 2 AS a
    FROM placed)
SELECT doc_id, size, source_size, target, list_sum(words)::BIGINT AS taken,
    CASE WHEN words[1] <= 0 THEN NULL WHEN abs(a) < 1e-12 THEN part
        ELSE (sqrt(1 + 4 * a * part * (1 + a)) - 1) / (2 * a) + 0.0 END AS position
FROM due
"""
