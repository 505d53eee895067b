"""Closed analytical templates over schedules, with provenance, absence, and audits of the values.

schedule rows: group, unit, school_year, lane, step, salary, source (where the value came from). One cell may hold
several rows; value and source always come from one row, the one with the largest value and then the smallest source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.taxonomy import LANES, lane_rank

TEMPLATES = ("step_slope", "max_at_step", "stipend_compare", "delta_over_years")
SALARY_MIN, SALARY_MAX = 30_000, 250_000


class UnsupportedQuery(ValueError):
    """A question that no template answers, or one that lacks a parameter."""


@dataclass(frozen=True)
class Decision:
    """What a router decided; any doubt means semantic."""

    kind: str
    query: str | None = None
    params: dict | None = None

    def checked(self) -> Decision:
        return self if self.kind == "analytical" and self.query in TEMPLATES else Decision("semantic")


def _order(metric: str, rank: str) -> list[Column]:
    return [F.col(metric).asc() if rank == "asc" else F.col(metric).desc(), F.col("grp")]


def _best() -> Column:
    """Value and source of the row with the largest value."""
    return F.max_by(F.struct("salary", "source"), F.struct("salary", -F.col("source")))


def _latest(rows: DataFrame, *keys: str) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.col("school_year").desc())
    return rows.withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").drop("__rn")


def step_slope(schedule: DataFrame, lane: str, step_from: int, step_to: int, rank: str = "desc") -> DataFrame:
    """Difference between two steps of a lane in each group's latest year that has both, ranked."""
    if step_from is None or step_to is None or step_from == step_to:
        raise UnsupportedQuery("step_slope needs two steps")
    cells = schedule.where((F.col("lane") == lane) & F.col("step").isin(step_from, step_to) & (F.col("unit") == "teacher"))
    at = lambda step: F.max_by(F.when(F.col("step") == step, F.struct("salary", "source")), F.when(F.col("step") == step, F.struct("salary", -F.col("source"))))
    years = cells.groupBy("grp", "school_year").agg(at(step_from).alias("a"), at(step_to).alias("b")).where("a is not null and b is not null")
    out = _latest(years, "grp").select("grp", "school_year", F.col("a.salary").alias("sal_from"), F.col("b.salary").alias("sal_to"), (F.col("b.salary") - F.col("a.salary")).alias("delta"), F.col("b.source").alias("source"))
    return out.orderBy(*_order("delta", rank))


def max_at_step(schedule: DataFrame, lane: str, step: int, rank: str = "desc") -> DataFrame:
    """Salary at a step of a lane in each group's latest year, ranked."""
    if step is None:
        raise UnsupportedQuery("max_at_step needs a step")
    cells = schedule.where((F.col("lane") == lane) & (F.col("step") == step) & (F.col("unit") == "teacher"))
    best = cells.groupBy("grp", "school_year").agg(_best().alias("v"))
    return _latest(best, "grp").select("grp", "school_year", F.col("v.salary").alias("salary"), F.col("v.source").alias("source")).orderBy(*_order("salary", rank))


def delta_over_years(schedule: DataFrame, lane: str, step: int) -> DataFrame:
    """Change between the first and last year of groups that have two or more; always the largest first."""
    cells = schedule.where((F.col("lane") == lane) & (F.col("step") == step) & (F.col("unit") == "teacher"))
    years = cells.groupBy("grp", "school_year").agg(F.max("salary").alias("salary"))
    spans = years.groupBy("grp").agg(
        F.min_by("salary", "school_year").alias("first_salary"), F.max_by("salary", "school_year").alias("last_salary"), F.min("school_year").alias("first_year"),
        F.max("school_year").alias("last_year"), F.count(F.lit(1)).alias("n_years"),
    )
    return spans.where("n_years >= 2").withColumn("delta", F.col("last_salary") - F.col("first_salary")).orderBy(F.col("delta").desc(), "grp")


def stipend_compare(stipends: DataFrame, position: str, rank: str = "desc") -> tuple[DataFrame, DataFrame]:
    """(flat and range amounts, percentages of base) of a position's latest year in each group and tier."""
    rows = stipends.where(F.col("position").ilike(f"%{position}%"))
    latest = lambda df: _latest(df, "grp", "position", "tier")
    amounts = latest(rows.where(F.col("amount_basis").isin("flat", "range"))).orderBy(*_order("amount", rank), "position", "tier")
    shares = latest(rows.where("amount_basis = 'percent_of_base'")).orderBy(*_order("amount_pct", rank), "position", "tier")
    return amounts, shares


def not_available(groups: DataFrame, found: DataFrame) -> DataFrame:
    """Groups that a template has no answer for."""
    return groups.select("grp").distinct().join(found.select("grp"), "grp", "left_anti").orderBy("grp")


def run(decision: Decision, schedule: DataFrame, stipends: DataFrame | None = None) -> DataFrame:
    """The template of a decision; an unknown one is refused."""
    d, p = decision.checked(), decision.params or {}
    if d.kind != "analytical":
        raise UnsupportedQuery("not an analytical question")
    if d.query == "step_slope":
        return step_slope(schedule, p.get("lane", "MA"), p.get("step_from"), p.get("step_to"), p.get("rank", "desc"))
    if d.query == "max_at_step":
        return max_at_step(schedule, p.get("lane", "MA"), p.get("step"), p.get("rank", "desc"))
    if d.query == "stipend_compare":
        if stipends is None or not p.get("position"):
            raise UnsupportedQuery("stipend_compare needs a position")
        return stipend_compare(stipends, p["position"], p.get("rank", "desc"))[0]
    if p.get("step") is None:
        raise UnsupportedQuery("delta_over_years needs a step")
    return delta_over_years(schedule, p.get("lane", "MA"), p["step"])


def _drops(rows: DataFrame, kind: str, keys: list[str], order: list, label: Column, distinct_on: str | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    before = rows.withColumn("before", F.lag("salary").over(w)).withColumn("__other", F.lag(distinct_on).over(w) != F.col(distinct_on) if distinct_on else F.lit(True))
    return before.where((F.col("salary") < F.col("before")) & F.col("__other")).select(F.lit(kind).alias("kind"), "grp", "unit", label.alias("cell"), "before", "salary")


def audit_steps(rows: DataFrame) -> DataFrame:
    """A later step that pays less."""
    cell = F.concat_ws("/", "school_year", "lane", F.col("step").cast("string"))
    return _drops(rows, "salary_non_monotonic", ["grp", "unit", "school_year", "lane"], ["step", "salary", "source"], cell)


def audit_lanes(rows: DataFrame, rank_of: Column | None = None) -> DataFrame:
    """A higher lane that pays less at the same step; lanes without rank take no part."""
    ordered = rows.withColumn("__rank", lane_rank(F.col("lane")) if rank_of is None else rank_of).where("__rank >= 0")
    cell = F.concat_ws("/", "school_year", "lane", F.col("step").cast("string"))
    return _drops(ordered, "lane_out_of_order", ["grp", "unit", "school_year", "step"], ["__rank", "salary", "source"], cell)


def audit_years(rows: DataFrame) -> DataFrame:
    """A cell that pays less in a later year."""
    cell = F.concat_ws("/", "school_year", "lane", F.col("step").cast("string"))
    return _drops(rows, "year_over_year_drop", ["grp", "unit", "lane", "step"], ["school_year", "salary", "source"], cell, "school_year")


def audit_bounds(rows: DataFrame, low: float = SALARY_MIN, high: float = SALARY_MAX) -> DataFrame:
    cell = F.concat_ws("/", "school_year", "lane", F.col("step").cast("string"))
    return rows.where((F.col("salary") < low) | (F.col("salary") > high)).select(F.lit("salary_out_of_bounds").alias("kind"), "grp", "unit", cell.alias("cell"), F.lit(None).cast("double").alias("before"), "salary")


def audit(rows: DataFrame) -> DataFrame:
    """All violations: cells to look at, not to reject."""
    return audit_steps(rows).unionByName(audit_lanes(rows)).unionByName(audit_years(rows)).unionByName(audit_bounds(rows))


def audit_stipends(rows: DataFrame) -> DataFrame:
    amounts = rows.unpivot(["grp", "position"], ["amount", "amount_high"], "field", "value")
    return amounts.where("value < 0").select(F.lit("stipend_negative").alias("kind"), "grp", "position", "field", "value")


__all__ = ["LANES", "TEMPLATES", "Decision", "UnsupportedQuery", "audit", "run"]
