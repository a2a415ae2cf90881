"""Text predicates and tokenisers as Spark columns (everything stays in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litweave import fixed
from litweave.functions.arrays import let

_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(col: Column) -> Column:
    """Trim Unicode white space on both ends (`trim` removes plain spaces only)."""
    return F.regexp_replace(col, _EDGES, "")


def blank_to(col: Column, default) -> Column:
    """Missing text is the empty string; swap it (and null) for `default`."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(col, F.lit("")), default)


def cut(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def hash_id(path: Column) -> Column:
    """12 hex digits identifying a paper by its path; a `file:` scheme is not part of it."""
    plain = F.regexp_replace(path, r"^file:(//)?(?=/)", "")
    return cut(F.md5(plain.cast("binary")), fixed.PAPER_ID_CHARS)


def slug(col: Column) -> Column:
    words = F.regexp_replace(F.lower(strip(F.coalesce(col, F.lit("")))), fixed.SLUG_BREAK, "_")
    return blank_to(F.trim(words, F.lit("_")), "unknown")


def file_slug(title: Column) -> Column:
    return blank_to(cut(slug(title), fixed.SLUG_FILE_CHARS), "review")


def search_tokens(text: Column) -> Column:
    """ASCII alphanumeric runs in order. Lower-casing comes last so that it can create none."""
    runs = F.regexp_extract_all(text, F.lit(fixed.SEARCH_TOKEN), F.lit(0))
    return F.transform(runs, F.lower)


def term_counts(tokens: Column) -> Column:
    """array<struct<term, tf>> of a token array, linear after one sort and without a shuffle.

    Sorting puts equal tokens side by side, so each run of one token is one regex match.
    """
    runs = F.regexp_extract_all(
        F.concat(F.lit(" "), F.array_join(F.sort_array(tokens), " ")),
        F.lit(r"( [a-z0-9]++)(?:\1(?![a-z0-9]))*+"),
        F.lit(0),
    )

    def entry(run: Column) -> Column:
        term = F.substring_index(F.ltrim(run), " ", 1)
        return F.struct(
            term.alias("term"), (F.length(run) / (F.length(term) + 1)).cast("int").alias("tf")
        )

    return F.transform(runs, entry)


def overlap_tokens(text: Column) -> Column:
    lowered = F.lower(text)
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(fixed.OVERLAP_TOKEN), F.lit(0)))


def overlap_ratio(quote: Column, source: Column) -> Column:
    """Share of the quote's token set found in the source; 0 when the quote has no token."""
    q, s = overlap_tokens(quote), overlap_tokens(source)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, s)) / F.size(q)).otherwise(F.lit(0.0))


def overlap_ok(quote: Column, source: Column, ratio: float = fixed.OVERLAP_RATIO) -> Column:
    has_tokens = F.size(overlap_tokens(quote)) > 0
    return F.coalesce(has_tokens & (overlap_ratio(quote, source) >= ratio), F.lit(False))


def is_noise(text: Column) -> Column:
    return text.rlike(fixed.NOISE_LINE)


def starts_with_keyword(text: Column) -> Column:
    return F.ltrim(text, F.lit(fixed.HEADING_NUMBER_CHARS)).rlike(fixed.SECTION_KEYWORDS)


def is_heading(text: Column, size: Column, body: Column) -> Column:
    keyword = starts_with_keyword(text)
    return (
        (F.length(text) <= fixed.HEADING_MAX_CHARS)
        & text.rlike("[A-Za-z]")
        & ~is_noise(text)
        & (
            (size >= body * fixed.HEADING_SCALE)
            | (keyword & (F.length(text) <= fixed.KEYWORD_HEADING_MAX_CHARS))
            | (text.rlike(fixed.NUMBERED_HEADING) & keyword)
        )
    )


def publication_year(creation_date: Column, text: Column) -> Column:
    """Creation year inside the valid range, else first arXiv stamp, else first 4-digit year, else 0."""

    def found(source: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(source, pattern, 1), F.lit("")).cast("int")

    created = found(F.coalesce(creation_date, F.lit("")), fixed.CREATION_YEAR)
    valid = created.between(fixed.MIN_CREATION_YEAR, fixed.MAX_CREATION_YEAR)
    in_text = let(
        text,
        lambda t: F.coalesce(found(t, fixed.ARXIV_YEAR) + 2000, found(t, fixed.TEXT_YEAR)),
    )
    return F.coalesce(F.when(valid, created), in_text, F.lit(0))


def paper_ids_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.PAPER_ID), F.lit(0))


def looks_like_review(text: Column) -> Column:
    return (F.length(text) >= fixed.REVIEW_MIN_CHARS) & ~F.lower(text).rlike(
        "|".join(fixed.PLACEHOLDER_WORDS)
    )


def longer_of(first: Column, second: Column) -> Column:
    """The longer text; a tie keeps the first."""
    return F.when(F.length(second) > F.length(first), second).otherwise(first)


def new_task_id() -> Column:
    """First 8 hex digits of a random UUID. Write the result before using it twice."""
    return cut(F.replace(F.uuid(), F.lit("-"), F.lit("")), 8)
