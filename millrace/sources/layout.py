"""Text and tables of paged files from what a reader reports of them: pages, blocks of text with their boxes, grids, images.

A PDF reader isn't part of the engine; it gives one row a page, a block, a grid or an image, and these functions put the
document together. Boxes are (x0, y0, x1, y1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A page with no more characters than this holds no text, an image over this share of it is its content; a block is a table's by this share of its area; grids have so many rows and columns.
IMAGE_PAGE_MAX_CHARS, IMAGE_PAGE_MIN_COVERAGE, COVERED, LEAST_ROWS, LEAST_COLUMNS = 120, 0.45, 0.5, 2, 2


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\x00"), F.lit(""))


def _joined(rows: DataFrame, keys: list[str], order: list[str], text: str, glue: str, out: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("__text"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["__text"]), glue).alias(out))


def page_text(pages: DataFrame, key: str) -> DataFrame:
    """key, text of all pages in order, page_count. pages: key, page, text."""
    text = _joined(pages, [key], ["page"], "text", "\n", "text").withColumn("text", F.trim(_clean(F.col("text")), F.lit(" \t\r\n")))
    return text.join(pages.groupBy(key).agg(F.count(F.lit(1)).alias("page_count")), key)


def area(box: str) -> Column:
    x0, y0, x1, y1 = (F.col(f"{box}.{c}") for c in ("x0", "y0", "x1", "y1"))
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    """Area that two boxes share."""
    side = lambda lo, hi: F.greatest(F.least(f"{a}.{hi}", f"{b}.{hi}") - F.greatest(f"{a}.{lo}", f"{b}.{lo}"), F.lit(0.0))
    return side("x0", "x1") * side("y0", "y1")


def image_only_pages(pages: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """key and page of scans among readable pages: hardly any text, and one image over much of the page. pages: key, page, text, box; images: key, page, box."""
    blank = pages.where(F.char_length(F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n"))) <= IMAGE_PAGE_MAX_CHARS).select(key, "page", area("box").alias("__whole")).where("__whole > 0")
    largest = images.groupBy(key, "page").agg(F.max(area("box")).alias("__image"))
    return blank.join(largest, [key, "page"]).where(F.col("__image") / F.col("__whole") >= IMAGE_PAGE_MIN_COVERAGE).select(key, "page")


def grids(tables: DataFrame) -> DataFrame:
    """Tables that are large enough and have content. tables: n_rows, n_columns, markdown."""
    return tables.where((F.col("n_rows") >= LEAST_ROWS) & (F.col("n_columns") >= LEAST_COLUMNS))


def prose_outside_grids(blocks: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """key and text without what stands in a grid. blocks: key, page, block, box, text; tables: key, page, box, n_rows, n_columns.

    Blocks meet the grids of their own page only, a handful; a block that has no area is never covered."""
    boxes = grids(tables).select(key, "page", F.col("box").alias("grid"))
    inside = blocks.join(boxes, [key, "page"]).where((area("box") > 0) & (overlap("box", "grid") / area("box") >= COVERED)).select(key, "page", "block").distinct()
    kept = blocks.join(inside, [key, "page", "block"], "left_anti")
    text = _joined(kept, [key], ["page", "block"], "text", "\n", "text").withColumn("text", F.trim(_clean(F.col("text")), F.lit(" \t\r\n")))
    return blocks.select(key).distinct().join(text, key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def merged(base: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """Documents with pages that were read later, as by OCR: the base's prose first, then the added; tables one after the other. Both: key, text, tables, page_count."""
    new = added.select(key, F.col("text").alias("__text"), F.col("tables").alias("__tables"), F.col("page_count").alias("__count"))
    both = base.join(new, key, "left")
    given = F.filter(F.array("text", "__text"), lambda t: t.isNotNull() & (t != ""))
    none = F.array().cast("array<string>")
    return both.select(
        key, F.trim(F.array_join(given, "\n\n"), F.lit(" \t\r\n")).alias("text"), F.concat(F.coalesce("tables", none), F.coalesce("__tables", none)).alias("tables"),
        F.when(F.coalesce("page_count", F.lit(0)) > 0, F.col("page_count")).otherwise(F.col("__count")).alias("page_count"),
    )
