"""Schedule rows from the JSON that an extraction model gave for a table. The model itself is outside: tables come with its answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalars, taxonomy

SALARY = "bargaining_unit string, salary_rows array<struct<step:string,lane_raw:string,salary:string,school_year:string,years_service:string,is_longevity:string>>"
STIPEND = "bargaining_unit string, stipend_rows array<struct<position:string,position_raw:string,school_year:string,category:string,tier:string,amount:string,amount_high:string,amount_pct:string,amount_basis:string>>"
BASES = ["flat", "range", "percent_of_base"]


def _parsed(tables: DataFrame, schema: str) -> DataFrame:
    return tables.withColumn("__m", F.from_json(scalars.json_object(F.col("answer")), schema))


def _fallback_year() -> Column:
    return F.coalesce(scalars.school_year_of_title(F.col("title")), scalars.school_year(F.col("day")))


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _salary(tables: DataFrame, crosswalk: DataFrame | None) -> DataFrame:
    rows = _parsed(tables, SALARY).select("table_id", "district", "title", "day", "section_path", taxonomy.unit(F.col("__m.bargaining_unit")).alias("unit"), F.explode("__m.salary_rows").alias("r"))
    read = F.nullif(_text("r.school_year"), F.lit(""))
    rows = rows.select(
        "table_id", "district", "unit", F.nullif(_text("r.lane_raw"), F.lit("")).alias("lane_raw"), scalars.integer(F.col("r.step")).alias("step"), scalars.number(F.col("r.salary")).alias("salary"),
        F.coalesce(read, _fallback_year()).alias("school_year"), read.isNull().alias("year_inferred"), scalars.integer(F.col("r.years_service")).alias("years_service"),
        scalars.boolean(F.col("r.is_longevity")).alias("is_longevity"), scalars.page_of_path(F.col("section_path")).alias("page"),
    )
    named = taxonomy.with_lane(rows, crosswalk)
    complete = F.col("salary").isNotNull() & F.col("step").isNotNull() & F.col("lane_raw").isNotNull() & F.col("school_year").isNotNull()
    # Lanes are a matter of teachers; other units' columns are titles and stay as printed.
    return named.withColumn("lane", F.when(F.col("unit") == "teacher", F.col("lane")).otherwise(F.col("lane_raw"))).withColumn("complete", complete)


def salary_rows(tables: DataFrame, crosswalk: DataFrame | None = None) -> DataFrame:
    """Complete salary rows of tables (table_id, answer, district, title, day, section_path)."""
    return _salary(tables, crosswalk).where("complete").drop("complete")


def salary_counts(tables: DataFrame, crosswalk: DataFrame | None = None) -> DataFrame:
    """How many rows were built and skipped."""
    return _salary(tables, crosswalk).agg(F.count_if("complete").alias("n_rows"), F.count_if(~F.col("complete")).alias("n_skipped"))


def stipend_rows(tables: DataFrame) -> DataFrame:
    """Stipend rows with a position and some amount; basis and category are inferred where the answer names no valid one."""
    rows = _parsed(tables, STIPEND).select("table_id", "title", "day", "section_path", taxonomy.unit(F.col("__m.bargaining_unit")).alias("unit"), F.explode("__m.stipend_rows").alias("r"))
    amount = {c: scalars.number(F.col(f"r.{c}")) for c in ("amount", "amount_high", "amount_pct")}
    raw = F.coalesce(F.nullif(_text("r.position_raw"), F.lit("")), F.nullif(_text("r.position"), F.lit("")))
    rows = rows.withColumns(amount).withColumn("position_raw", raw).where(F.col("position_raw").isNotNull() & F.coalesce("amount", "amount_high", "amount_pct").isNotNull())
    basis, kind = F.lower(_text("r.amount_basis")), F.lower(_text("r.category"))
    return rows.select(
        "table_id", "unit", taxonomy.position(F.coalesce(F.col("r.position"), F.col("position_raw"))).alias("position"), "position_raw", F.coalesce(F.nullif(_text("r.school_year"), F.lit("")), _fallback_year(), F.lit("")).alias("school_year"),
        F.when(kind.isin("athletics", "cocurricular", "extra_duty"), kind).otherwise(taxonomy.category(F.col("position_raw"))).alias("category"), _text("r.tier").alias("tier"), *amount,
        F.when(basis.isin(BASES), basis).when(F.col("amount_pct").isNotNull(), "percent_of_base").when(F.col("amount_high").isNotNull(), "range").otherwise("flat").alias("amount_basis"),
        scalars.page_of_path(F.col("section_path")).alias("page"),
    )
