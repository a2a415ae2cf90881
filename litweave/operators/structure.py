"""Layout structure of one paper as column expressions over its line array.

No function here shuffles: sections and chunks are slices of the line array of a row. The only
sequential rule, the character budget of a chunk, is a fold over line lengths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litweave import fixed
from litweave.functions.arrays import empty, let
from litweave.functions.text import cut, is_heading, is_noise, strip

_FOLD_BLOCK = 4096


def body_size(lines: Column) -> Column:
    """Font size carrying most characters; the size seen first wins a tie."""

    def weigh(size: Column, i: Column) -> Column:
        chars = F.aggregate(
            F.filter(lines, lambda l: l["size"] == size),
            F.lit(0).cast("long"),
            lambda n, l: n + F.length(l["text"]),
        )
        return F.struct(chars.alias("chars"), (-i).alias("first"), size.alias("size"))

    sizes = F.array_distinct(F.transform(lines, lambda l: l["size"]))
    heaviest = F.array_max(F.transform(sizes, weigh))
    return F.coalesce(heaviest["size"], F.lit(fixed.DEFAULT_BODY_SIZE))


def title(lines: Column, fallback: Column) -> Column:
    """First-page lines of the largest size, in order; they need not be adjacent."""

    def largest(front: Column) -> Column:
        return let(
            F.array_max(F.transform(front, lambda l: l["size"])),
            lambda top: F.filter(front, lambda l: l["size"] == top),
        )

    front = F.filter(lines, lambda l: (l["page"] == 0) & ~is_noise(l["text"]))
    found = let(front, largest)
    text = cut(strip(F.array_join(F.transform(found, lambda l: l["text"]), " ")), fixed.TITLE_MAX_CHARS)
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def flagged_lines(lines: Column, body: Column) -> Column:
    """Lines with `heading`: does the line open a section?"""


    def flag(l: Column, body_size: Column) -> Column:
        return F.struct(
            l["page"].alias("page"),
            l["line_no"].alias("line_no"),
            l["text"].alias("text"),
            is_heading(l["text"], l["size"], body_size).alias("heading"),
        )

    return let(body, lambda b: F.transform(lines, lambda l: flag(l, b)))


def sections(lines: Column, body: Column) -> Column:
    """array<struct<section_no, section, lines>>; headings without a body vanish."""

    def between(flagged: Column, starts: Column) -> Column:
        def section(start: Column, j: Column) -> Column:
            end = F.coalesce(F.get(starts, j + 1), F.size(flagged))
            name = F.when(start < 0, F.lit(fixed.FRONT_SECTION)).otherwise(
                F.get(flagged, start)["text"]
            )
            return F.struct(
                j.alias("section_no"),
                name.alias("section"),
                F.slice(flagged, start + 2, end - start - 1).alias("lines"),
            )

        return F.filter(F.transform(starts, section), lambda s: F.size(s["lines"]) > 0)

    def split(flagged: Column) -> Column:
        positions = F.transform(flagged, lambda l, i: F.when(l["heading"], i))
        heads = F.filter(positions, lambda i: i.isNotNull())
        return let(F.concat(F.array(F.lit(-1)), heads), lambda starts: between(flagged, starts))

    return let(flagged_lines(lines, body), split)


def cut_points(lengths: Column, size: int, overlap: int) -> Column:
    """Indexes of the lines after which a chunk closes.

    The buffer grows by each line; at `size` it closes and restarts with the `overlap` tail. The
    fold runs in blocks so that appending to the result never copies a long array.
    """

    def line_step(acc: Column, length: Column) -> Column:
        full = acc["buf"] + length >= size
        return F.struct(
            F.when(full, F.lit(overlap)).otherwise(acc["buf"] + length).alias("buf"),
            F.when(full, F.array_append(acc["cuts"], acc["i"])).otherwise(acc["cuts"]).alias("cuts"),
            (acc["i"] + 1).alias("i"),
        )

    def block_step(acc: Column, block: Column) -> Column:
        inner = F.aggregate(
            F.slice(lengths, block * _FOLD_BLOCK + 1, _FOLD_BLOCK),
            F.struct(
                acc["buf"].alias("buf"),
                empty("int").alias("cuts"),
                (block * _FOLD_BLOCK).alias("i"),
            ),
            line_step,
        )
        return let(
            inner,
            lambda r: F.struct(
                r["buf"].alias("buf"), F.array_append(acc["cuts"], r["cuts"]).alias("cuts")
            ),
        )

    last_block = F.floor((F.size(lengths) - 1) / _FOLD_BLOCK).cast("int")
    start = F.struct(F.lit(0).alias("buf"), empty("array<int>").alias("cuts"))
    return F.flatten(
        F.aggregate(F.sequence(F.lit(0), last_block), start, block_step, lambda acc: acc["cuts"])
    )


def section_chunks(section: Column, size: int, overlap: int) -> Column:
    """Chunks of one section. A section that ends on a cut still yields its overlap tail.

    `page` is the first page of the section (every chunk starts with the tail of the one before,
    so the buffer is never empty again); `start_page` is the page of the first new line.
    """

    def assemble(lines: Column, cuts: Column) -> Column:
        last = F.size(lines) - 1
        starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c + 1))

        def raw(start: Column, k: Column) -> Column:
            n = F.coalesce(F.get(cuts, k), last) - start + 1
            text = F.array_join(
                F.transform(F.slice(lines, start + 1, n), lambda l: l["text"]), "\n"
            )
            return F.struct(
                F.get(lines, F.least(start, last))["page"].alias("start_page"),
                F.when(n > 0, F.concat(text, F.lit("\n"))).otherwise(F.lit("")).alias("raw"),
            )

        def finish(raws: Column) -> Column:
            def chunk(c: Column, k: Column) -> Column:
                before = F.coalesce(F.get(raws, k - 1)["raw"], F.lit(""))
                text = F.concat(F.right(before, F.lit(overlap)), c["raw"]) if overlap else c["raw"]
                page = F.get(lines, F.lit(0))["page"] if overlap else c["start_page"]
                return F.struct(
                    section["section"].alias("section"),
                    page.alias("page"),
                    c["start_page"].alias("start_page"),
                    strip(text).alias("text"),
                )

            return F.transform(raws, chunk)

        return let(F.transform(starts, raw), finish)

    def with_cuts(lines: Column) -> Column:
        return let(
            F.transform(lines, lambda l: F.length(l["text"]) + 1),
            lambda lengths: let(
                cut_points(lengths, size, overlap), lambda cuts: assemble(lines, cuts)
            ),
        )

    return let(section["lines"], with_cuts)


def chunks(
    sections_col: Column, size: int = fixed.CHUNK_CHARS, overlap: int = fixed.CHUNK_OVERLAP
) -> Column:
    """All chunks of a paper in order, blank ones removed; the array index is `chunk_index`."""
    if not 0 <= 2 * overlap <= size:
        raise ValueError("overlap must not exceed half the chunk size")
    per_section = F.transform(sections_col, lambda s: section_chunks(s, size, overlap))
    return F.filter(F.flatten(per_section), lambda c: c["text"] != "")
