"""Functions over the text of generated feature programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The forms in which programs name and document their features.
_TARGET = r"df_output\[\s*['\"]([^'\"\]]+)['\"]\s*\]\s*=(?!=)"
_THOUGHT = r"Thought\s*([0-9]*)\s*:\s*([^|\n]*)"
_FEATURE = r"New Feature\s*([0-9]*)\s*:\s*([^\n]*)"
# Comments and string literals, triple-quoted ones first.
_TEXT_PARTS = r"""(?s)\"{3}.*?\"{3}|'{3}.*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|#[^\n]*"""


def _lines(code: Column) -> Column:
    return F.split(code, "\n")


def code_lines(code: Column) -> Column:
    """Only the lines that assign to the output frame, unchanged."""
    kept = F.filter(_lines(code), lambda line: F.rlike(line, F.lit(r"^\s*df_output\[")))
    return F.array_join(kept, "\n")


def without_score_lines(code: Column) -> Column:
    """Drops lines that echo the score of an earlier program."""
    kept = F.filter(_lines(code), lambda line: ~F.contains(line, F.lit("This program scored:")))
    return F.array_join(kept, "\n")


def assigned_features(code: Column) -> Column:
    """Names of the output columns that a program assigns, in order."""
    return F.regexp_extract_all(code, F.lit(_TARGET), F.lit(1))


def feature_catalog(programs: DataFrame, code: str, *keys: str) -> DataFrame:
    """One row per documented feature: keys, position, thought, name, formula.

    Both documented forms are read: ``Thought 1: …`` with ``New Feature 1: name | name = formula``, and
    ``Thought: … | New Feature: name = formula``. A feature without a thought of its number has none (NULL); thoughts
    without a feature are not features.
    """
    def numbered(pattern: str) -> Column:
        numbers = F.regexp_extract_all(F.col(code), F.lit(pattern), F.lit(1))
        texts = F.regexp_extract_all(F.col(code), F.lit(pattern), F.lit(2))
        return F.arrays_zip(numbers.alias("k"), texts.alias("t"))

    # a numbered thought belongs to the feature of its number; those without a number are paired in their order
    found = programs.select(*keys, numbered(_THOUGHT).alias("__t"), F.posexplode(numbered(_FEATURE)).alias("pos", "__f"))
    plain = F.filter("__t", lambda t: t["k"] == "")
    of_number = F.filter("__t", lambda t: (t["k"] != "") & (t["k"].try_cast("bigint") == F.col("__f.k").try_cast("bigint")))
    thought = F.when(F.col("__f.k") == "", F.get(plain, F.col("pos"))["t"]).otherwise(F.get(of_number, F.lit(0))["t"])
    pairs = found.select(*keys, "pos", F.struct(thought.alias("t"), F.col("__f.t").alias("f")).alias("col"))
    text = F.trim(F.col("col.f"))
    has_bar = F.contains(text, F.lit("|"))
    name = F.when(has_bar, F.split_part(text, F.lit("|"), F.lit(1))).otherwise(F.split_part(text, F.lit("="), F.lit(1)))
    return pairs.filter(text.isNotNull()).select(
        *keys,
        F.col("pos").cast("int").alias("position"),
        F.trim(F.col("col.t")).alias("thought"),
        F.trim(name).alias("feature_name"),
        F.trim(F.regexp_replace(text, r"^[^=]*=", "")).alias("formula"),
    )


def head_type(code: Column) -> Column:
    return F.when(F.contains(code, F.lit("<Operators>")), F.lit("operations")).otherwise(F.lit("domain"))


def record_text(index: Column, score: Column, code: Column) -> Column:
    """The text that is shown to a reviewer for one program."""
    return F.concat(
        F.lit("--- Program Index "),
        index.cast("string"),
        F.lit(" ---\nScore: "),
        F.coalesce(score.cast("string"), F.lit("None")),
        F.lit("\nCode:\n"),
        F.coalesce(code, F.lit("")),
        F.lit("\n"),
    )


def without_text_parts(code: Column) -> Column:
    """Code without comments and with string literals emptied, so that only what runs is left."""
    return F.regexp_replace(code, F.lit(_TEXT_PARTS), F.lit("''"))


def has_loop(code: Column) -> Column:
    return F.rlike(without_text_parts(code), F.lit(r"(?m)^\s*(for|while)\b"))


def calls_ancestor(code: Column, function: str = "modify_features") -> Column:
    """Whether a version of ``function`` is called or defined; comments, strings and attributes do not count."""
    return F.rlike(without_text_parts(code), F.lit(rf"(?<![A-Za-z0-9_.]){function}_v\w*\s*\("))


def looks_ahead(code: Column) -> Column:
    """A shift, difference or change by a negative number of rows reads the future."""
    return F.rlike(code, F.lit(r"\b(shift|diff|pct_change)\(\s*(periods\s*=\s*)?-"))
