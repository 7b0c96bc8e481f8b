"""Secret scan with corpus-wide ownership frequency.

Every text is searched for credentials of a known form (assignments, access keys, hex strings) and for *opaque*
strings that only look like one. What an opaque string is worth depends on who holds it: its hash is counted over
distinct repositories and distinct owners of the whole corpus. A string held by one owner in few repositories looks
live and is reported as kind ``owned``; one that many owners copied is an example and is not. Credentials of a
known form stay in the result whatever their frequency; the same counts grade them as ``live`` or ``example``.

The counts are three aggregations with map-side sums, (hash, owner, repository) -> (hash, owner) -> (hash), so that no
string, however common, gathers its rows in one task. Grades are joined back from a written table, which the planner
broadcasts by its size or joins by shuffle with skew splitting.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colwright.llm.common import key_of, slices
from colwright.storage import cut_lineage

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "owned")
#: A string of at most so many owners and repositories counts as owner-specific.
MAX_OWNERS = 1
MAX_REPOSITORIES = 3
#: An opaque string has at least so many characters, and so many bits of entropy per character.
OPAQUE_CHARS = 20
OPAQUE_BITS = 3.5

# The forms of credentials.
_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]+"
_HEX = r"[0-9a-f]{16,}"  # the runs [0-9a-f]+ of 16 and more
_OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"

_FOUND = "array<struct<kind:int,start:int,end:int,value:bigint>>"


def bits_per_character(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def looks_opaque(s: str) -> bool:
    """Digits, upper and lower case mixed, and as even as random characters are."""
    return (
        len(s) >= OPAQUE_CHARS
        and any(c.isdigit() for c in s)
        and any("a" <= c <= "z" for c in s)
        and any("A" <= c <= "Z" for c in s)
        and bits_per_character(s) >= OPAQUE_BITS
    )


def find_candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of all candidates; opaque strings inside a span of a known form are left out."""
    found = []
    for m in re.finditer(_ASSIGN, text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 12:
            found.append((0, m.start(), m.end(), m[2]))
    for m in re.finditer(_ACCESS, text):
        if m.end() - m.start() >= 18:
            found.append((1, m.start(), m.end(), m[0]))
    for m in re.finditer(_HEX, text):
        found.append((2, m.start(), m.end(), m[0]))
    known = sorted((s, e) for _, s, e, _ in found)
    at, reach = 0, 0  # spans that start before the end of the present string, and how far they reach
    for m in re.finditer(_OPAQUE, text):
        while at < len(known) and known[at][0] < m.end():
            reach = max(reach, known[at][1])
            at += 1
        if reach <= m.start() and looks_opaque(m[0]):
            found.append((3, m.start(), m.end(), m[0]))
    return sorted(found, key=lambda x: (x[1], x[0]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64())])
    for batch in slices(batches):
        found = [
            [dict(zip(("kind", "start", "end", "value"), (k, s, e, key_of(v.encode())), strict=True)) for k, s, e, v in find_candidates(t or "")]
            for t in batch.column("text").to_pylist()
        ]
        keep = [batch.column(c) for c in ("doc_id", "owner", "repository")]
        names = ["doc_id", "owner", "repository", "found"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(found, pa.list_(span))], names=names)


def scan(df: DataFrame, id_col: str, text_col: str, owner_col: str, repository_col: str) -> DataFrame:
    """One row per document with all candidates found in its whole text, written, with a row number ``row``."""
    slim = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{owner_col}`").cast("string").alias("owner"),
        F.col(f"`{repository_col}`").cast("string").alias("repository"),
    )
    kind = slim.schema["doc_id"].dataType.simpleString()
    rows = slim.mapInArrow(_scan, f"doc_id {kind}, owner string, repository string, found {_FOUND}")
    return cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")


def ownership(scanned: DataFrame) -> DataFrame:
    """Per candidate value: in how many distinct repositories and of how many distinct owners it occurs."""
    held = scanned.select("owner", "repository", F.explode("found.value").alias("value"))
    places = held.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
    owners = places.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("uses").alias("uses"))
    return owners.groupBy("value").agg(
        F.sum("repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"), F.sum("uses").alias("n_uses")
    )


def graded_spans(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: str = "doc_id",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per row of ``df``: ``row``, ``doc_id`` and ``spans``, an array of (start, kind, end, live) by start and kind.

    ``kind`` is the place in ``KINDS``, offsets are code points, and ``live`` tells whether the value is specific to its
    owner. Opaque strings that are not owner-specific are left out. NULL and empty texts have an empty array, a NULL
    owner or repository counts as one of its own, and repeated rows are scanned one by one (their repository is counted
    once).
    """
    scanned = scan(df, id_col, text_col, owner_col, repository_col)
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    grades = cut_lineage(ownership(scanned).select("value", live.alias("live")), "ownership")
    spans = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    graded = spans.join(grades, "value").filter(F.col("live") | (F.col("kind") < 3))
    per_row = graded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    return (
        scanned.select("row", "doc_id")
        .join(per_row, "row", "left")
        .select("row", "doc_id", F.coalesce("spans", none).alias("spans"))
    )


def spans_text(spans: str, only_base: bool = False):
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    chosen = F.filter(spans, lambda s: s["kind"] < 3) if only_base else F.col(spans)
    one = F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(one, ",")


def summary(graded: DataFrame) -> DataFrame:
    """Counts per kind, digest and list of the spans, and how many of them look live or are widely copied."""

    def count(test):
        return F.size(F.filter("spans", test)).cast("long")

    def of_kind(i: int):
        return lambda s: s["kind"] == i

    return graded.select(
        "doc_id",
        *[count(of_kind(i)).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(spans_text("spans", True), 256).alias("base_sha256"),
        spans_text("spans").alias("spans"),
        count(of_kind(3)).alias("n_owned"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"),
    )


def base_digest(text: str) -> str:
    """Digest of the spans of known form of one text, for checks."""
    base = [f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in find_candidates(text) if k < 3]
    return hashlib.sha256(",".join(base).encode()).hexdigest()


def redact(df: DataFrame, text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id") -> DataFrame:
    """``df`` with every credential of known form, and every owner-specific opaque string, replaced by its kind in brackets.

    Opaque strings are graded over all rows of ``df``. Columns and rows stay as they are; only ``text_col`` changes. The
    values to be masked are looked up by hash, so rows need no number of their own: a text without opaque strings is
    masked where it stands, and the rows with such strings are joined with the grades of their strings.
    """
    marks = _mask_columns(df, text_col)
    held = df.select(
        F.col(f"`{owner_col}`").cast("string").alias("owner"),
        F.col(f"`{repository_col}`").cast("string").alias("repository"),
        marks.alias("found"),
    )
    held = held.filter(F.size("found") > 0).select("owner", "repository", F.transform("found", lambda v: F.struct(v.alias("value"))).alias("found"))
    counted = ownership(held)
    live = counted.filter((F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repositories") <= MAX_REPOSITORIES))
    # an owner-specific value belongs to at most MAX_REPOSITORIES repositories: attach it to those only
    homes = held.select("owner", "repository", F.explode("found.value").alias("value")).distinct()
    owned = homes.join(live.select("value"), "value").groupBy("owner", "repository").agg(F.collect_set("value").alias("values"))
    owned = cut_lineage(owned, "owned").select(F.col("owner").alias("__own"), F.col("repository").alias("__rep"), F.col("values").alias("__values"))
    same = df[owner_col].cast("string").eqNullSafe(F.col("__own")) & df[repository_col].cast("string").eqNullSafe(F.col("__rep"))
    joined = df.join(owned, same, "left")
    masked = _mask_udf()(df[text_col], F.col("__values"))
    return joined.select(*[masked.alias(c) if c == text_col else df[c] for c in df.columns])


def _mask_columns(df: DataFrame, text_col: str):
    @F.pandas_udf("array<bigint>")
    def opaque_values(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({key_of(v.encode()) for k, _, _, v in find_candidates(t or "") if k == 3}))

    return opaque_values(F.coalesce(df[text_col].cast("string"), F.lit("")))


def mask(text: str | None, owned: set[int]) -> str | None:
    """The text with its credentials replaced; overlapping spans are masked as one, named after the first."""
    if text is None:
        return None
    out, at = [], 0
    for k, s, e, v in find_candidates(text):
        if k == 3 and key_of(v.encode()) not in owned:
            continue
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _mask_udf():
    @F.pandas_udf("string")
    def masked(texts: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([mask(t, set() if v is None else {int(x) for x in v}) for t, v in zip(texts, values, strict=True)], dtype=object)

    return masked
