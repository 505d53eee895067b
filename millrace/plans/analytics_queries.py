"""Queries of the analytical templates, audits and structured rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars, taxonomy
from millrace.operators import analytics, structured
from millrace.plans.models import SCHEDULE_SQL, schedule
from millrace.plans.registry import load, query


def _cells(where: str) -> str:
    return f"with s as ({SCHEDULE_SQL}), c as (select grp, school_year, step, max(salary) as salary, arg_max(source, (salary, -source)) as source from s where {where} group by 1, 2, 3)"


@query(
    _cells("lane = 'MA' and step in (1, 5)")
    + """, y as (select a.grp, a.school_year, a.salary as sal_from, b.salary as sal_to, b.salary - a.salary as delta, b.source, row_number() over (partition by a.grp order by a.school_year desc) as rn
        from c a join c b on a.grp = b.grp and a.school_year = b.school_year and a.step = 1 and b.step = 5)
    select grp, school_year, round(sal_from, 4) as sal_from, round(sal_to, 4) as sal_to, round(delta, 4) as delta, source from y where rn = 1"""
)
def step_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.run(analytics.Decision("analytical", "step_slope", {"lane": "MA", "step_from": 1, "step_to": 5}), schedule(spark, sf_dir))
    return out.withColumns({c: F.round(c, 4) for c in ("sal_from", "sal_to", "delta")})


@query(_cells("lane = 'MA' and step = 3") + ", y as (select *, row_number() over (partition by grp order by school_year desc) as rn from c) select grp, school_year, salary, source from y where rn = 1")
def max_at_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.run(analytics.Decision("analytical", "max_at_step", {"lane": "MA", "step": 3, "rank": "asc"}), schedule(spark, sf_dir))


@query(
    _cells("lane = 'BA' and step = 2")
    + "select grp, arg_min(salary, school_year) as first_salary, arg_max(salary, school_year) as last_salary, min(school_year) as first_year, max(school_year) as last_year, count(*) as n_years, round(arg_max(salary, school_year) - arg_min(salary, school_year), 4) as delta from c group by 1 having count(*) >= 2"
)
def delta_over_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.run(analytics.Decision("analytical", "delta_over_years", {"lane": "BA", "step": 2}), schedule(spark, sf_dir))
    return out.withColumn("delta", F.round("delta", 4))


STIPENDS_SQL = """
    select p_partkey % 20 as grp, p_type as position, cast(2000 + p_size as varchar) as school_year, p_brand as tier, p_retailprice as amount,
           case when p_partkey % 5 = 0 then 'percent_of_base' when p_partkey % 2 = 0 then 'range' else 'flat' end as amount_basis,
           case when p_partkey % 5 = 0 then p_size / 2.0 end as amount_pct, p_partkey as source from part
"""


def _stipends(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        (k % 20).alias("grp"), F.col("p_type").alias("position"), (F.col("p_size") + 2000).cast("string").alias("school_year"), F.col("p_brand").alias("tier"), F.col("p_retailprice").alias("amount"),
        F.when(k % 5 == 0, "percent_of_base").when(k % 2 == 0, "range").otherwise("flat").alias("amount_basis"), F.when(k % 5 == 0, F.col("p_size") / 2).alias("amount_pct"), k.alias("source"),
    )


@query(f"""
    with s as ({STIPENDS_SQL}),
    best as (select grp, position, tier, max(school_year) as school_year from s where position ilike '%mo%' and amount_basis in ('flat', 'range') group by 1, 2, 3)
    select grp, position, tier, school_year, round(max(amount), 4) as amount from best join s using (grp, position, tier, school_year) where amount_basis in ('flat', 'range') group by 1, 2, 3, 4""")
def stipend_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stipends(spark, sf_dir).groupBy("grp", "position", "tier", "school_year", "amount_basis").agg(F.max("amount").alias("amount"), F.max("amount_pct").alias("amount_pct"))
    unique = rows.groupBy("grp", "position", "tier", "school_year", F.col("amount_basis").isin("flat", "range").alias("plain")).agg(F.max("amount").alias("amount"), F.max("amount_pct").alias("amount_pct"))
    amounts, _ = analytics.stipend_compare(unique.withColumn("amount_basis", F.when(F.col("plain"), "flat").otherwise("percent_of_base")), "mo")
    return amounts.select("grp", "position", "tier", "school_year", F.round("amount", 4).alias("amount"))


@query(f"""
    with s as ({STIPENDS_SQL}),
    p as (select grp, position, tier, school_year, max(amount_pct) as amount_pct from s where position ilike '%mo%' and amount_basis = 'percent_of_base' group by 1, 2, 3, 4)
    select grp, position, tier, arg_max(amount_pct, school_year) as amount_pct, max(school_year) as school_year from p group by 1, 2, 3""")
def stipend_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stipends(spark, sf_dir).groupBy("grp", "position", "tier", "school_year", "amount_basis").agg(F.max("amount").alias("amount"), F.max("amount_pct").alias("amount_pct"))
    _, shares = analytics.stipend_compare(rows, "mo")
    return shares.select("grp", "position", "tier", "amount_pct", "school_year")


@query(_cells("lane = 'MA' and step in (6, 7) and school_year >= '1996-97'") + """select s_suppkey as grp from supplier where s_suppkey not in (select a.grp from c a join c b on a.grp = b.grp and a.school_year = b.school_year and a.step = 6 and b.step = 7)""")
def not_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that a template has no answer for."""
    found = analytics.step_slope(schedule(spark, sf_dir).where("school_year >= '1996-97'"), "MA", 6, 7)
    return analytics.not_available(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("grp")), found)


CELL_SQL = "school_year || '/' || lane || '/' || step"


@query(f"""
    with s as ({SCHEDULE_SQL}), l as (select *, lag(salary) over (partition by grp, unit, school_year, lane order by step, salary, source) as before from s)
    select 'salary_non_monotonic' as kind, grp, unit, {CELL_SQL} as cell, before, salary from l where salary < before""")
def audit_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.audit_steps(schedule(spark, sf_dir))


@query(f"""
    with s as (select *, case lane when 'BA' then 0 when 'BA+30' then 2 else 4 end as r from ({SCHEDULE_SQL})), l as (select *, lag(salary) over (partition by grp, unit, school_year, step order by r, salary, source) as before from s)
    select 'lane_out_of_order' as kind, grp, unit, {CELL_SQL} as cell, before, salary from l where salary < before""")
def audit_lane_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.audit_lanes(schedule(spark, sf_dir))


@query(f"""
    with s as ({SCHEDULE_SQL}), l as (select *, lag(salary) over w as before, lag(school_year) over w as y from s window w as (partition by grp, unit, lane, step order by school_year, salary, source))
    select 'year_over_year_drop' as kind, grp, unit, {CELL_SQL} as cell, before, salary from l where salary < before and y <> school_year""")
def audit_year_over_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.audit_years(schedule(spark, sf_dir))


@query(f"select 'salary_out_of_bounds' as kind, grp, unit, {CELL_SQL} as cell, cast(null as double) as before, salary from ({SCHEDULE_SQL}) where salary < 30000 or salary > 250000")
def audit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.audit_bounds(schedule(spark, sf_dir))


@query("""
    with s as (select c_nationkey as grp, c_name as position, c_acctbal as amount, c_acctbal - 500 as amount_high from customer)
    select 'stipend_negative' as kind, grp, position, field, value from (unpivot s on amount, amount_high into name field value value) where value < 0""")
def audit_stipend_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return analytics.audit_stipends(c.select(F.col("c_nationkey").alias("grp"), F.col("c_name").alias("position"), F.col("c_acctbal").alias("amount"), (F.col("c_acctbal") - 500).alias("amount_high")))


def _model_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model may answer for a table, fenced and with odd values; one a order."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    price = F.format_string("%.2f", "o_totalprice")
    lane = F.when(F.col("o_orderstatus") == "F", "Master + 30").when(F.col("o_orderstatus") == "O", "BA15").otherwise("Column X")
    row = F.concat(F.lit('{"salary_rows": [{"step": "'), (F.col("o_orderkey") % 8).cast("string"), F.lit('", "lane_raw": "'), lane, F.lit('", "salary": "$'), price, F.lit('"}, {"step": "—", "lane_raw": "MA", "salary": "1"}]}'))
    return o.select(
        F.col("o_orderkey").alias("table_id"), F.concat(F.lit("```json\n"), row, F.lit("\n```")).alias("answer"), F.lit("d1").alias("district"), F.concat(F.lit("T"), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit("#1")).alias("section_path"),
        F.concat(F.lit("PFA Agreement "), (F.year("o_orderdate") + 20).cast("string"), F.lit("-"), (F.year("o_orderdate") + 23).cast("string")).alias("title"), F.to_date("o_orderdate").alias("day"),
    )


@query("""
    select o_orderkey as table_id, (year(o_orderdate) + 20) || '-' || lpad(cast((year(o_orderdate) + 21) % 100 as varchar), 2, '0') as school_year,
           case o_orderstatus when 'F' then 'MA+30' when 'O' then 'BA+15' else 'other' end as lane, cast(o_orderkey % 8 as integer) as step,
           round(o_totalprice, 2) as salary, 'teacher' as unit, cast(o_orderkey % 9 + 1 as integer) as page, true as year_inferred from orders""")
def salary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule rows from a model's JSON: numbers and lanes normalised, incomplete rows skipped, the year of the title as fallback."""
    return structured.salary_rows(_model_tables(spark, sf_dir)).select("table_id", "school_year", "lane", "step", "salary", "unit", "page", "year_inferred")


@query("select cast(count(*) as bigint) as n_rows, cast(count(*) as bigint) as n_skipped from orders")
def salary_rows_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.salary_counts(_model_tables(spark, sf_dir))


@query("""
    select p_partkey as table_id, p_name as position, case when p_partkey % 3 = 0 then 'range' else 'flat' end as amount_basis, p_retailprice as amount,
           case when p_partkey % 3 = 0 then p_retailprice + 100 end as amount_high, 'extra_duty' as category, 'other' as unit from part""")
def stipend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    high = F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") + 100)
    rows = F.to_json(F.struct(F.lit("Stagehands").alias("bargaining_unit"), F.array(F.struct(F.col("p_name").alias("position_raw"), F.col("p_retailprice").cast("string").alias("amount"), high.cast("string").alias("amount_high"))).alias("stipend_rows")))
    tables = p.select(F.col("p_partkey").alias("table_id"), rows.alias("answer"), F.lit("T1#1").alias("section_path"), F.lit("x").alias("title"), F.lit(None).cast("date").alias("day"))
    return structured.stipend_rows(tables).select("table_id", "position", "amount_basis", "amount", "amount_high", "category", "unit")


@query("select o_orderkey, case when month(o_orderdate) >= 7 then year(o_orderdate) else year(o_orderdate) - 1 end || '-' || lpad(cast((case when month(o_orderdate) >= 7 then year(o_orderdate) else year(o_orderdate) - 1 end + 1) % 100 as varchar), 2, '0') as school_year, cast(date_trunc('week', o_orderdate) as date) as week_start, strftime(o_orderdate, '%Y-%m') as month from orders")
def school_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators.series import binned

    d = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.school_year(d).alias("school_year"), scalars.week_start(d).alias("week_start"), binned(d, "month").alias("month"))


@query(r"""
    with t as (select o_orderkey, 'Minutes of ' || strftime(o_orderdate, '%B %-d, %Y') || ', file ' || strftime(o_orderdate, '%Y%m%d') as title, o_orderdate, 'Contract ' || year(o_orderdate) + 20 || '–' || year(o_orderdate) + 23 as term from orders)
    select o_orderkey, cast(o_orderdate as date) as meeting_date, case when year(o_orderdate) >= 2000 then cast(o_orderdate as date) end as file_date, (year(o_orderdate) + 20) || '-' || lpad(cast((year(o_orderdate) + 21) % 100 as varchar), 2, '0') as term_year from t""")
def dates_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and school years read from titles."""
    d = F.col("o_orderdate")
    title = F.concat(F.lit("Minutes of "), F.date_format(d, "MMMM d, yyyy"), F.lit(", file "), F.date_format(d, "yyyyMMdd"))
    term = F.concat(F.lit("Contract "), (F.year(d) + 20).cast("string"), F.lit("–"), (F.year(d) + 23).cast("string"))
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.meeting_date(title).alias("meeting_date"), scalars.compact_date(title).alias("file_date"), scalars.school_year_of_title(term).alias("term_year"))


@query("""
    with r as (select s_suppkey, s_acctbal, case s_suppkey % 5 when 0 then '—' when 1 then ' $' || printf('%,.2f', s_acctbal) when 2 then printf('%.2f', s_acctbal) || '%' when 3 then 'about ' || printf('%.2f', s_acctbal) else 'n/a' end as raw from supplier)
    select s_suppkey, case when s_suppkey % 5 in (1, 2, 3) then round(s_acctbal, 2) end as number, case when s_suppkey % 5 in (1, 2, 3) then cast(trunc(round(s_acctbal, 2)) as integer) end as whole from r""")
def printed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("s_acctbal"), F.col("s_suppkey") % 5
    raw = F.when(k == 0, "—").when(k == 1, F.concat(F.lit(" $"), F.format_number(s, 2))).when(k == 2, F.concat(F.format_string("%.2f", s), F.lit("%"))).when(k == 3, F.concat(F.lit("about "), F.format_string("%.2f", s))).otherwise("n/a")
    return load(spark, sf_dir, "supplier").select("s_suppkey", scalars.number(raw).alias("number"), scalars.integer(raw).alias("whole"))


UNITS = ["", "teacher aide", "Building Principal", "CSEA custodial", "Office staff", "Federation of Teachers", "School nurse", "Lunch aide", "Safety officer", "Cafeteria", "Bus driver", "Musicians", "monitor"]


@query("""
    select s_suppkey, ['teacher', 'aide', 'administrator', 'custodial', 'clerical', 'teacher', 'nurse', 'monitor', 'security', 'food_service', 'transportation', 'other', 'monitor'][s_suppkey % 13 + 1] as unit,
           ['BA', 'MA+30', 'Doctorate', 'other', 'other', 'BA+45'][s_suppkey % 6 + 1] as lane, [0, 7, 12, -1, -1, 3][s_suppkey % 6 + 1] as lane_rank,
           ['athletics', 'cocurricular', 'extra_duty'][s_suppkey % 3 + 1] as category from supplier""")
def taxonomy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of units, lanes and positions."""
    pick = lambda names: F.element_at(F.lit(names), (F.col("s_suppkey") % len(names) + 1).cast("int"))
    lane = taxonomy.lane_by_pattern(pick(["Bachelor's", "M.A. + 30", "Ph.D.", "March", "MA+99", "BA45"]))
    return load(spark, sf_dir, "supplier").select(
        "s_suppkey", taxonomy.unit(pick(UNITS)).alias("unit"), lane.alias("lane"), taxonomy.lane_rank(lane).alias("lane_rank"), taxonomy.category(pick(["Swim Coach", "Drama club", "Hall duty"])).alias("category")
    )


@query("""
    select s_suppkey, ['minutes', 'transcript', 'agenda', 'policy', 'handbook', 'contract', 'budget', 'other'][s_suppkey % 8 + 1] as by_title,
           ['handbook', 'contract', 'policy', 'budget', 'minutes', 'agenda', null][s_suppkey % 7 + 1] as by_link from supplier""")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by title and by link; the two rule lists differ in order."""
    pick = lambda names: F.element_at(F.lit(names), (F.col("s_suppkey") % len(names) + 1).cast("int"))
    titles = ["Board_Minutes", "Meeting Transcript", "Work-Session", "Budget Adoption Policy", "Student Handbook", "MOU 2020", "Tax Report Card", "Photo"]
    urls = ["/x/handbook-policy.pdf", "/x/salary schedule.pdf", "/by-laws.pdf", "/budget.pdf", "/minutes.pdf", "/agenda.pdf", "/photo.pdf"]
    return load(spark, sf_dir, "supplier").select("s_suppkey", taxonomy.doc_type_of_title(pick(titles)).alias("by_title"), taxonomy.doc_type_of_link(pick(urls), F.lit("Open")).alias("by_link"))
