"""Meeting portals from what they answer: committees, meetings, agenda files, and addresses of portals in pages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LISTED = "array<struct<unique:string,name:string,numberdate:string>>"


def _listed(df: DataFrame, raw: str) -> DataFrame:
    """One row an entry of a JSON list, in its order; what isn't a list gives none."""
    return df.withColumn("__e", F.from_json(F.col(raw), LISTED)).select(*(c for c in df.columns if c != raw), F.posexplode("__e").alias("place", "__e")).where("__e.unique is not null")


def committees(df: DataFrame, raw: str = "body") -> DataFrame:
    """df's columns with place, committee id and name."""
    return _listed(df, raw).select("*", F.col("__e.unique").alias("unique"), F.trim("__e.name").alias("name")).drop("__e")


def number_date(c: Column) -> Column:
    """YYYYMMDD as a date, null for anything else."""
    return F.when(c.rlike(r"^\d{8}$"), F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date"))


def meetings(df: DataFrame, keys: list[str], raw: str = "body", since: date | None = None, most: int | None = None) -> DataFrame:
    """Meetings of each key in the portal's order: those before `since` go, undated ones stay, and the first `most` are walked."""
    rows = _listed(df, raw).select("*", F.col("__e.unique").alias("unique"), F.trim("__e.name").alias("name"), number_date(F.col("__e.numberdate")).alias("day")).drop("__e")
    if since is not None:
        rows = rows.where(F.col("day").isNull() | (F.col("day") >= F.lit(since)))
    if most is None:
        return rows
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("place"))).where(F.col("__n") <= most).drop("__n")


def agenda_files(links: DataFrame) -> DataFrame:
    """Attachments among an agenda's links (target, link_text): those whose address holds a file, each once, with its name."""
    files = links.where(F.col("target").rlike(r"(?i)/files?/|\$file|\.(pdf|docx?|rtf)(\?|$)")).dropDuplicates(["target"])
    return files.withColumn("file_name", F.regexp_extract("target", r"([^/?#]*)(?:[?#].*)?$", 1))


def harvested(df: DataFrame, html: str, pattern: str) -> DataFrame:
    """Each address that the pattern finds in a page, once a page, for the discovery of portals."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(pattern), F.lit(0)))
    return df.withColumn("address", F.explode(found)).drop(html)
