from __future__ import annotations

import random
import re
import unicodedata

from pyspark.sql import functions as F

from millrace.functions import fts, scalars, taxonomy, text

CLEAN = "The students and teachers of the district will present their plan for the school year to the board."
PROCEDURAL = "Motion by Smith, seconded by Jones. All in favor. Meeting adjourned. Call to order. Approval of the minutes."
GIBBERISH = "xqz ## @@ vbn kjh zzq ;;; wqx plm"
SPANISH = "Nuestra misión es la educación de los estudiantes y la comunidad en todas las escuelas del distrito"


def test_chunk_verdicts(spark):
    df = spark.createDataFrame([(1, CLEAN), (2, PROCEDURAL), (3, GIBBERISH), (4, SPANISH), (5, "Page 3"), (6, "Total $ 500"), (7, None)], "id int, text string")
    got = {r.id: (r.status, r.reason) for r in text.with_chunk_verdict(df).collect()}
    assert got[1] == ("active", None) and got[4] == ("active", None) and got[6] == ("active", None)
    assert got[2] == ("quarantined", "procedural")
    assert got[3] == ("quarantined", "garbled")
    assert got[5] == got[7] == ("quarantined", "too_short")


def test_quality_of_blank_text(spark):
    row = text.with_verdict(text.with_quality(spark.createDataFrame([("  \n",), (None,)], "text string"))).collect()
    assert all((r.non_alpha_ratio, r.avg_word_len, r.dict_word_ratio, r.word_count, r.reason) == (1.0, 0.0, 0.0, 0, "too_short") for r in row)


def test_content_classes(spark):
    samples = ["", "NOTICE IS HEREBY GIVEN by the SUPREME COURT that all of the land is for him", "For sale at the house on the hill, one good horse", "the school and the board will meet on the first of the year", "a b c d e f g"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "id int, text string")
    words = text.ENGLISH + ["hereby", "given", "supreme", "court", "land", "sale", "horse", "hill", "house", "board", "meet"]
    got = [r.c for r in df.select("id", text.content_class(F.col("text"), words).alias("c")).orderBy("id").collect()]
    assert got == [text.BAD_OCR, text.LEGAL_NOTICE, text.AD, text.CONTENT, text.BAD_OCR]


def test_words_of_the_list_are_found_in_one_cut(spark):
    rng = random.Random(3)
    parts = ["the", "The", "and", "don't", "-", "--", ".", "(", "\u2014", "\u2022", "\u00e9", "x", "'the'", " ", " ", "  ", "\n", "\t", "\u00a0", "\U0001f600"]
    samples = ["", " ", "-", "--the", "the--", "-- the -- and --", "the-and", " (the) ", "the.\n", *("".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(3000))]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    for edges in (text.WORD_EDGES, text.TOKEN_EDGES):
        known = text.known_words(F.col("t"), ["the", "and", "don't"], edges)
        want = [sum(w.strip(edges) in ("the", "and", "don't") for w in re.split(r"[ \t\n\f\r\x0b]+", s.lower())) for s in samples]
        assert [r.n for r in df.select(known.alias("n")).collect()] == want
        assert "regexp_replace" not in str(known)


def test_families_look_for_words_before_patterns(spark):
    shown = [[s] for s in ("ROLL\tCALL", "Members present", "absent:", "motion by", "Seconded by", "moved by", "all in favor", "carried unanimously", "AYES: 3", "nay -", "abstention", "approval of minutes", "minutes of the last MEETING", "consent agenda", "call to ORDER", "adjourns", "pledge of allegiance", "executive session", "public comment", "next board meeting", "point of information")]
    assert [r.n for r in spark.createDataFrame([*shown, ["rolling"], [None]], "t string").select(text.families(F.col("t")).alias("n")).collect()] == [1] * len(shown) + [0, 0]
    plan = spark.createDataFrame([("a",)], "t string").select(F.lower("t"), text.families(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"{w})" in plan for parts in text.FAMILY_PARTS.values() for words, _ in parts for w in words)


def test_controls_go_wherever_they_stand(spark):
    samples = [chr(c) + "a" + chr(c) for c in [*range(0x300), *range(0x2000, 0x2070), 0xFEFE, 0xFEFF, 0xFF00]]
    got = [r.t for r in spark.createDataFrame([(s,) for s in samples], "t string").select(text.without_controls(F.col("t")).alias("t")).collect()]
    assert got == [re.sub(text.CONTROLS, "", s) for s in samples]


def test_only_texts_that_may_change_leave_for_normal_forms(spark):
    rng = random.Random(5)
    parts = ["a", "E", "\u00e9", "\u00c5", "\u02ff", "e\u0301", "\u0301", "\u0323", "\u212b", "\u1100\u1161", "\uac00\u11a8", "\ufb01", "\u00df", "\u00b5", "\u03a3", "\U0001d15e", " ", "\n", "\x00"]
    samples = ["", None, *(chr(c) for c in range(0x400)), *("".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(2000))]
    df = spark.createDataFrame([(s,) for s in samples], "t string").coalesce(1).select(text.nfc(F.col("t")).alias("a"), text.nfkc_casefold(F.col("t")).alias("b"))
    want = [(None, None) if s is None else (unicodedata.normalize("NFC", s), unicodedata.normalize("NFKC", s).casefold()) for s in samples]
    assert [tuple(r) for r in df.collect()] == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.count("CASE WHEN RLIKE(t#") >= 2


def test_clean_ocr(spark):
    df = spark.createDataFrame([("  a\x00b \t c\n \n \n\nd  ",), ("é",), (None,)], "t string")
    assert [r.c for r in df.select(text.clean_ocr(F.col("t")).alias("c")).collect()] == ["ab c\n\nd", "é", ""]


def test_slugs(spark):
    df = spark.createDataFrame([("Board Minutes (2024).pdf",), ("???",), ("x" * 200,)], "t string")
    assert [r.s for r in df.select(text.slug(F.col("t")).alias("s")).collect()] == ["Board-Minutes-2024-.pdf", "untitled", "x" * 120]
    row = df.select(text.extension(F.lit("Reg.docx (22 KB)")).alias("a"), text.extension(F.lit("Reg.DOCX")).alias("b"), text.file_name(F.lit("http://h/a/b%20c.pdf?x=1#y")).alias("c")).first()
    assert tuple(row) == ("", ".docx", "b c.pdf")


def test_scalars(spark):
    df = spark.range(1)
    row = df.select(
        scalars.number(F.lit("$1,234.50")), scalars.number(F.lit("—")), scalars.number(F.lit("about 12 days")), scalars.integer(F.lit("7.9")), scalars.boolean(F.lit("Yes")), scalars.boolean(F.lit(None).cast("string")),
        scalars.school_year(F.lit("2024-06-30").cast("date")), scalars.school_year(F.lit("1999-07-01").cast("date")), scalars.school_year_of_title(F.lit("PFA Agreement 2023-2026")), scalars.school_year_of_title(F.lit("none")),
        scalars.json_object(F.lit('Sure:\n```json\n{"a": 1}\n```')), scalars.json_object(F.lit("[1]")), scalars.page_of_path(F.lit("T12#2")), scalars.page_of_path(F.lit("P3.A")), scalars.meeting_date(F.lit("on February 30, 2024")).cast("string"),
        scalars.token_estimate(F.lit("x" * 30)),
    ).first()
    assert tuple(row) == (1234.5, None, 12.0, 7, True, False, "2023-24", "1999-00", "2023-24", None, '{"a": 1}', None, 12, None, None, 21)


def test_lanes_and_units(spark):
    raw = ["Master's + 30", "MA30", "B.A.", "BS+15", "Ph.D.", "March", "MA+99", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    lanes = [r.x for r in df.select("i", taxonomy.lane_by_pattern(F.col("r")).alias("x")).orderBy("i").collect()]
    assert lanes == ["MA+30", "MA+30", "BA", "BA+15", "Doctorate", "other", "other", "other", "other"]
    units = df.select(*(taxonomy.unit(F.lit(u)) for u in ("Teacher Aide", "", "Custodians", "Violinists"))).first()
    assert tuple(units) == ("aide", "teacher", "custodial", "other")


def test_crosswalk_goes_first(spark):
    rows = spark.createDataFrame([("a", "Lane  X"), ("b", "lane x"), ("c", "MA30")], "district string, lane_raw string")
    cross = spark.createDataFrame([("a", "lane x", "MA"), (None, "lane x", "BA")], "district_slug string, lane_raw string, lane_canonical string")
    assert [r.lane for r in taxonomy.with_lane(rows, cross).orderBy("district").collect()] == ["MA", "BA", "MA+30"]


def test_citations(spark):
    row = spark.range(1).select(text.citations(F.lit("see [3] and [1], [3]")), text.bad_citations(F.lit("[0] [2] [9]"), F.lit(3)), text.is_label_refusal(F.lit("The passages do not show")), text.is_refusal(F.lit("does not address it [1]"), "does not address")).first()
    assert tuple(row) == ([1, 3], [0, 9], True, False)


def test_prefix(spark):
    row = spark.range(1).select(text.embedding_prefix(F.lit("north"), F.lit(None).cast("date"), F.lit("Reports"), F.lit("Budget")), text.embedding_prefix(F.lit("north"), F.lit("2024-05-01").cast("date"), F.lit("Reports"), F.lit("Reports"))).first()
    assert tuple(row) == ("north · undated · Reports › Budget", "north · 2024-05-01 · Reports")


def test_full_text(spark):
    df = spark.createDataFrame([(1, "The school budget vote"), (2, "budget of schools"), (3, "vote on the budget for school"), (4, None)], "doc_id int, text string")
    ids = lambda q: [r.doc_id for r in fts.search(df, "text", q).collect()]
    assert ids("school budget") == [1, 3]
    assert ids('"school budget"') == [1]
    assert ids("budget -vote") == [2]
    assert ids("nothing or schools") == [2]
    assert ids("the of") == [] and ids("") == [] and ids("-vote") == []
    ranked = fts.ranked_by_cover(df, "schools budget").orderBy(F.desc("cover_rank"), "doc_id").collect()
    assert [r.doc_id for r in ranked] == [1, 2, 3]


def test_cover_density_worked_cases():
    q = fts.parse("a1 b1")
    assert fts.cover_density("a1 b1", q) == 0.2
    assert fts.covers([(1, "x"), (2, "y"), (5, "x")], {"x", "y"}) == [(1, 2), (2, 5)]
    assert 0 < fts.cover_density("a1 z z b1", q) < 0.2
    assert fts.cover_density("a1 only", q) == 0


def test_cover_rank_follows_phrases_and_negations(spark):
    q = fts.parse('budget vote -idiot or "school board"', stemmed=True)
    rank = lambda t: fts.cover_density(t, q)
    assert rank("budget vote") > rank("budget of the long and slow vote") > 0
    assert rank("budget vote idiot") == rank("budget idiots vote") == 0
    assert rank("the school boards") > 0 and rank("school for the board") > 0  # stop words fall away
    assert rank("board school") == rank("school lunch board") == rank(None) == 0
    df = spark.createDataFrame([(1, "Budget votes"), (2, "budget vote, idiot"), (3, None)], "id int, text string")
    assert [r.id for r in fts.ranked_by_cover(df, "budget vote -idiot", id_col="id").collect()] == [1]


def test_native_cover_ranks_by_brute_force(spark):
    """Postings and windows against the walk through each text."""
    rng = random.Random(3)
    words = ["thing", "things", "the", "this", "wills", "budget", "budgets", "policies", "policy", "vote", "idiot", "x", "école"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 30, 80])))) for i in range(120)] + [(900, None), (901, "Budget-Vote, budget's VOTE")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    for stemmed in (True, False):
        for q in ["budget", "budget vote", "thing vote policy", 'thing or "budget of vote" -idiot', '-idiot', "the", "policies école -x or vote vote", '"budget vote policy" -"thing thing"']:
            want = {i: fts.cover_density(t, fts.parse(q, stemmed), stemmed) for i, t in texts}
            got = {r.doc_id: r.cover_rank for r in fts.ranked_by_cover(df, q, stemmed=stemmed).collect()}
            assert got.keys() == {i for i, v in want.items() if v > 0} and all(abs(v - want[i]) < 1e-9 for i, v in got.items()), (q, stemmed)
