from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import chunking
from millrace.plans import text_queries


def test_windows_without_sentences():
    words = [f"w{i}" for i in range(100)]
    spans = chunking.windows(words, 10, 2)
    assert spans[:2] == [(0, 10), (8, 18)]
    assert spans[-1][1] == 100


def test_window_ends_at_sentence():
    words = [f"w{i}" for i in range(30)]
    words[6] = "end."
    assert chunking.windows(words, 10, 2)[0] == (0, 7)


def test_only_the_last_character_ends_a_sentence():
    words = [f"w{i}" for i in range(30)]
    words[6] = 'end."'
    assert chunking.windows(words, 10, 2)[0] == (0, 10)


def test_bad_sizes():
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            chunking.windows(["a"], size, overlap)
    assert chunking.windows([]) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "c"]), max_size=2000))
def test_default_windows_cover_all_words(words):
    spans = chunking.windows(words)
    covered = {i for a, b in spans for i in range(a, b)}
    assert covered == set(range(len(words)))


AGENDA = """Board of Education
1. Call to Order
The meeting began.
3. Not next
2. Consent Agenda
Intro text.
A. Approve minutes
detail one
B. Approve bills
3. Reports
A. Budget
"""


def test_outline_takes_parts_in_sequence():
    segments = chunking.outline(AGENDA)
    assert [s["path"] for s in segments] == [["header"], ["P1"], ["P2"], ["P2", "A"], ["P2", "B"], ["P3"], ["P3", "A"]]
    assert "3. Not next" in segments[1]["text"]
    assert chunking.outline("A. letter before any part\ntext")[0]["path"] == ["header"]


def test_sections():
    out = chunking.sections(AGENDA)
    assert [c["section_path"] for c in out] == ["header", "P1", "P2.A", "P2.B", "P3"]
    assert out[2]["content"].startswith("Consent Agenda\nIntro text.\n\nApprove minutes")
    assert out[4]["content"] == "Reports\n\nBudget"
    assert [c["chunk_index"] for c in out] == list(range(5))


def test_large_sections_split():
    text = "1. Reports\n" + " ".join(f"word{i}" for i in range(900)) + "\nA. One\nB. Two"
    paths = [c["section_path"] for c in chunking.sections(text)]
    assert paths == ["P1#1", "P1#2", "P1#3", "P1.A", "P1.B"]
    assert chunking.sections("") == []


def test_frames(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two. three")], "id long, text string")
    rows = chunking.window_chunks(df).collect()
    assert [(r.id, r.word_start, r.word_end, r.content) for r in rows] == [(3, 0, 3, "one two. three")]
    assert [r.section_path for r in chunking.section_chunks(df).collect()] == ["header"]


def test_agendas_hold_every_sentence_and_turn(spark, tmp_path):
    long = " ".join(f"Sentence {i} " + "word " * 60 + "ends." for i in range(30))
    rows = [(1, 0, "One. Two."), (1, 1, long), (1, None, "Without a turn."), (2, None, "Alone."), (3, 0, None), (3, 1, "After a null text.")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    text = {r.conv_id: r.text for r in text_queries._agendas(spark.read.parquet(f"{tmp_path}/conversations.parquet")).collect()}
    assert all(f"Sentence {i} word" in text[1] for i in range(30)) and text[1].endswith("3. Reports\nA. Without a turn.")
    assert text[2] == "1. Reports\nA. Alone." and "2. Consent Agenda\nA. After a null text." in text[3]
    paths = [r.section_path for r in text_queries.section_chunks(spark, str(tmp_path)).where("conv_id = 1").orderBy("chunk_index").collect()]
    assert paths == ["P1", *(f"P2.{chr(65 + i % 26)}" for i in range(30)), "P3"]
    assert {r.conv_id for r in text_queries.section_chunks(spark, str(tmp_path)).collect()} == {1, 2, 3}
