"""Normal forms of bargaining units, salary lanes, positions and document types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Canonical lanes from least to most credited, units, and the patterns that name them, in order.
LANES = ["BA", "BA+15", "BA+30", "BA+45", "MA", "MA+15", "MA+20", "MA+30", "MA+40", "MA+45", "MA+60", "MA+75", "Doctorate"]
UNITS = ["teacher", "administrator", "custodial", "aide", "clerical", "nurse", "monitor", "security", "food_service", "transportation", "other"]
UNIT_RULES = [
    (r"teacher.?aide|teaching assistant|paraprofessional|\bpara\b|teacher assistant", "aide"),
    (r"administrat|principal|supervisor|director|\bsaanys\b|building leader|assistant superintendent", "administrator"),
    (r"custodi|maintenance|grounds|facilit|\bciti\b|building service|\bseiu\b|\bcsea\b", "custodial"),
    (r"cleric|secretar|\btypist\b|account clerk|office staff", "clerical"),
    (r"teacher|faculty|instructional|\bta\b|federation of teachers|teachers?\s*associat", "teacher"),
    (r"\bnurse\b|health\s+aide|rn\b|lpn\b", "nurse"),
    (r"monitor|lunch\s*aide|hall\s*monitor|recess", "monitor"),
    (r"security|guard|\bsro\b|safety officer", "security"),
    (r"food\s*service|cafeteria|kitchen|cook\b", "food_service"),
    (r"transport|\bbus\b|driver|mechanic", "transportation"),
]
DOCTORATE, MASTER, BACHELOR = r"doctor|ph\.?\s*d|ed\.?\s*d|\bdr\b", r"master|m\.?\s*a(?=\d|\b)|\bms\b|\bm\b|m\s*\+", r"bachelor|b\.?\s*a(?=\d|\b)|\bbs\b|\bb\b|b\s*\+"
ATHLETICS = r"coach|athletic|basketball|football|soccer|baseball|softball|volleyball|track|wrestl|tennis|lacrosse|swim|cross.?country|golf|cheer|hockey|gymnastic|fitness|intramural"
COCURRICULAR = r"advisor|adviser|club|yearbook|newspaper|musical|drama|theat|band|chorus|orchestra|honor society|student council|robotics|debate|mock trial|forensic|model un|nhs|dei|gsa"
TITLE_RULES = [
    (["minute"], "minutes"),
    (["transcript"], "transcript"),
    (["agenda", "business meeting", "work session", "boe meeting", "board meeting", "special meeting", "regular meeting", "retreat"], "agenda"),
    (["policy", "policies", "regulation"], "policy"),
    (["handbook"], "handbook"),
    (["contract", "agreement", "mou"], "contract"),
    (["budget", "financial statement", "tax report card", "fiscal accountability"], "budget"),
]
LINK_RULES = [
    (r"handbook", "handbook"),
    (r"collective\s*bargain|negotiat|bargaining\s*unit|\bcba\b|\bmou\b|\bmoa\b|memorandum of (agreement|understanding)|\bcontract\b|\bagreement\b|salary\s*schedule|step\s*schedule|teachers?\s*associat|faculty\s*associat|federation of teachers", "contract"),
    (r"\bpolic(y|ies)\b|regulation|by-?law", "policy"),
    (r"budget|adopted\s+budget|financial\s+statement", "budget"),
    (r"minutes", "minutes"),
    (r"agenda", "agenda"),
]


def first_rule(rules: list[tuple[Column, str]], otherwise: Column | None) -> Column:
    """Value of the first condition that holds."""
    rest = F.lit(None).cast("string") if otherwise is None else otherwise
    return reduce(lambda acc, rule: F.when(rule[0], F.lit(rule[1])).otherwise(acc), reversed(rules), rest)


def unit(raw: Column) -> Column:
    """Canonical bargaining unit: a blank label is teacher, an unknown one is other."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    by_rule = first_rule([(s.rlike(f"(?i){p}"), u) for p, u in UNIT_RULES], F.lit("other"))
    return F.when(s == "", "teacher").when(F.lower(s).isin(UNITS), F.lower(s)).otherwise(by_rule)


def lane_rank(lane: Column) -> Column:
    """Place in LANES from 0; -1 if unknown."""
    return (F.array_position(F.lit(LANES), F.coalesce(lane, F.lit(""))) - 1).cast("int")


def lane_by_pattern(raw: Column) -> Column:
    """Canonical lane of a printed label, or other."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    base = F.when(s.rlike(f"(?i){MASTER}"), "MA").when(s.rlike(f"(?i){BACHELOR}"), "BA")
    credits = F.regexp_extract(s, r"(\d{2})", 1)
    lane = F.when(credits == "", base).otherwise(F.concat(base, F.lit("+"), credits.cast("int").cast("string")))
    return F.when(s == "", "other").when(s.rlike(f"(?i){DOCTORATE}"), "Doctorate").when(lane.isin(LANES), lane).otherwise("other")


def clean(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), r"\s+", " ")


def with_lane(rows: DataFrame, crosswalk: DataFrame | None, raw: str = "lane_raw", group: str = "district", out: str = "lane") -> DataFrame:
    """rows with the canonical lane: the group's own mapping, else the one for all groups, else the patterns.

    crosswalk: district_slug (null for all), lane_raw (clean), lane_canonical."""
    if crosswalk is None:
        return rows.withColumn(out, lane_by_pattern(F.col(raw)))
    keyed = rows.withColumn("__key", clean(F.col(raw)))
    own = crosswalk.where("district_slug is not null").select(F.col("district_slug").alias("__g"), F.col("lane_raw").alias("__k"), F.col("lane_canonical").alias("__own"))
    every = crosswalk.where("district_slug is null").select(F.col("lane_raw").alias("__e"), F.col("lane_canonical").alias("__all"))
    met = keyed.join(own, (F.col(group) == F.col("__g")) & (F.col("__key") == F.col("__k")), "left").join(every, F.col("__key") == F.col("__e"), "left")
    named = F.when(F.trim(F.coalesce(F.col(raw), F.lit(""))) == "", "other").otherwise(F.coalesce("__own", "__all", lane_by_pattern(F.col(raw))))
    return met.withColumn(out, named).drop("__key", "__g", "__k", "__own", "__e", "__all")


def category(position: Column) -> Column:
    p = F.coalesce(position, F.lit(""))
    return F.when(p.rlike(f"(?i){ATHLETICS}"), "athletics").when(p.rlike(f"(?i){COCURRICULAR}"), "cocurricular").otherwise("extra_duty")


def position(raw: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"\s+", " ")


def doc_type_of_title(title: Column) -> Column:
    low = F.regexp_replace(F.lower(title), r"[-_]+", " ")
    return first_rule([(reduce(lambda a, b: a | b, (low.contains(k) for k in keys)), kind) for keys, kind in TITLE_RULES], F.lit("other"))


def doc_type_of_link(url: Column, text: Column) -> Column:
    """Type by link text and URL; null if it is no target. The rules have another order than those of titles."""
    hay = F.concat_ws(" ", text, url)
    return first_rule([(hay.rlike(f"(?i){p}"), kind) for p, kind in LINK_RULES], None)
