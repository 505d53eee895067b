from __future__ import annotations

import datetime
import gzip
import io
import json
import zipfile

import pytest

from millrace.sources import documents, layout, manifests, portals

HTML = """<html><head><title>no</title></head><body><script>x()</script><h1>Attendance</h1><p>Rules <b>apply</b>.</p>
<table><tr><th>Grade</th><th>Allowed absences</th></tr><tr><td>K|1</td><td>18 / full year</td></tr><tr><td>only</td></tr></table><br>End</body></html>"""


def test_html():
    prose, tables = documents.html_document(HTML)
    assert prose == "Attendance\nRules\napply\n.\nEnd"
    assert tables == ["| Grade | Allowed absences |\n|---|---|\n| K/1 | 18 / full year |\n| only |  |"]
    assert documents.html_document(None) == ("", [])


def test_links():
    html = '<a href="/a#x">One <b>two</b></a><a href="#y">n</a><a href="mailto:z">n</a><a>n</a><a href="http://o/b">Three</a>'
    assert documents.links(html, "http://h/p/") == [("http://h/a", "One two"), ("http://o/b", "Three")]


def test_policies():
    html = '<div class="export-section page-break" id="s1" data-bookmark-title="0110.2-E SEXUAL HARASSMENT"><p class="section-title">T</p><p>' + "word " * 30 + '</p><div class="section-footer">f</div></div><div class="export-section" id="s2"><p class="section-title">5000 STUDENT POLICIES</p></div><div class="export-section" id="s3" data-bookmark-title="0115 STUDENT BULLYING"></div>'
    out = documents.policies(html, "https://p.example/b/north/s/1")
    assert [(p["number"], p["suffix"], p["substantive"]) for p in out] == [("0110.2", "E", True), ("5000", "", False), ("0115", "", False)]
    assert out[0]["source_url"] == "https://p.example/b/north/s/s1"
    assert "f" not in out[0]["text"].split()


def test_rtf():
    raw = r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator X;}Caf\'e9 \b bold\b0 \par Line two \u8212? dash \{ok\}}"
    assert documents.rtf_text(raw) == "Café bold\nLine two — dash {ok}"


def test_docx(spark, tmp_path):
    buffer = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.HTML").write_text(HTML)
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.docx").write_bytes(b"broken")
    rows = {r.path[-6:]: r for r in documents.extract(documents.read_files(spark, str(tmp_path)).select("path", "content")).collect()}
    assert rows["a.docx"].text == "One line\nTwo"
    assert len(rows["b.HTML"].tables) == 1
    assert rows["/c.pdf"].error == "no parser for .pdf" and rows["d.docx"].error.startswith("BadZipFile")


def test_portal_lists():
    assert documents.json_list('{"x": 1, "items": [{"a": 1}, 2]}') == [{"a": 1}]
    assert documents.json_list('[{"a": 1}]') == [{"a": 1}] and documents.json_list("no") == []
    assert documents.chosen_books(["Policies", "Draft policies"]) == ["Policies"]
    assert documents.chosen_books(["Draft"]) == ["Draft"] and documents.chosen_books([]) == []


def entry(url, sha, doc_type="policy"):
    return {"district": "north", "doc_type": doc_type, "title": "T", "source_url": url, "local_path": f"/old/root/north/policy/{sha}.html", "sha256": sha}


def test_manifests(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    (tmp_path / "a" / "manifest.jsonl").write_text("\n".join(map(json.dumps, [entry("u1", "s1"), entry("u2", "s2", "agenda")])) + "\n\n")
    (tmp_path / "b" / "manifest.jsonl").write_text(json.dumps(entry("u1", "s1")))
    found = manifests.manifest(spark, str(tmp_path))
    assert found.count() == 3
    assert [r.source_url for r in manifests.gathered([found, found]).collect()] == ["u1", "u2"]
    assert [r.source_url for r in manifests.gathered([found], doc_type="agenda", most=5).collect()] == ["u2"]
    files = spark.createDataFrame([("/new/north/policy/s1.html",)], "path string")
    assert {r.source_url: r.path for r in manifests.resolved(found.dropDuplicates(["source_url"]), files).collect()} == {"u1": "/new/north/policy/s1.html", "u2": None}
    assert found.select(manifests.store_path(found)).first()[0].startswith("north/")


def test_bad_manifests_fail(spark, tmp_path):
    (tmp_path / "manifest.jsonl").write_text(json.dumps(entry("u", "s", "novel")))
    with pytest.raises(Exception, match="unknown doc_type"):
        manifests.manifest(spark, str(tmp_path)).collect()


def test_snapshot_is_idempotent(spark, tmp_path):
    lines = [{"district": "d", "title": "t", "source_url": f"u{i}", "fetched_at": "x", "html": "<p>1</p>"} for i in (1, 2, 2)]
    with gzip.open(tmp_path / "s.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, lines)))
    first = manifests.snapshot(spark, str(tmp_path / "s.jsonl.gz"))
    assert first.count() == 2
    assert manifests.snapshot(spark, str(tmp_path / "s.jsonl.gz"), first.select("source_url", "sha256")).count() == 0


def test_crosswalk_and_words(spark, tmp_path):
    (tmp_path / "c.csv").write_text("# note\ndistrict_slug,lane_raw,lane_canonical\n,Col  A,MA\nnorth,col a,BA\n,,\n")
    rows = {(r.district_slug, r.lane_raw): r.lane_canonical for r in manifests.crosswalk(spark, str(tmp_path / "c.csv")).collect()}
    assert rows == {(None, "col a"): "MA", ("north", "col a"): "BA"}
    (tmp_path / "w.txt").write_text("The\n\n of \nthe\n")
    assert {r.word for r in manifests.word_list(spark, str(tmp_path / "w.txt")).collect()} == {"the", "of"}


def test_rtf_groups_without_text():
    hidden = "footnote rsidtbl colorschememapping latentstyles datastore xmlnstbl filetbl revtbl upr shppict nonshppict".split()
    raw = r"{\rtf1 before" + "".join("{\\" + w + " junk {\\b deeper}}" for w in hidden) + r" after\par {\FOOTER x}end}"
    assert documents.rtf_text(raw) == "before after\nend"


def test_pages_and_grids(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    blocks = spark.createDataFrame([(1, 1, 0, (0.0, 0.0, 10.0, 10.0), "prose"), (1, 1, 1, (0.0, 20.0, 10.0, 30.0), "cell"), (1, 2, 0, (0.0, 20.0, 10.0, 30.0), "next page\x00"), (1, 2, 1, (5.0, 5.0, 5.0, 5.0), None), (2, 1, 0, (0.0, 0.0, 4.0, 4.0), "cell")], f"doc int, page int, block int, box {box}, text string")
    tables = spark.createDataFrame([(1, 1, (0.0, 15.0, 10.0, 26.0), 3, 2), (1, 2, (0.0, 20.0, 10.0, 30.0), 1, 9), (2, 1, (0.0, 0.0, 9.0, 9.0), 2, 2)], f"doc int, page int, box {box}, n_rows int, n_columns int")
    assert {r.doc: r.text for r in layout.prose_outside_grids(blocks, tables, "doc").collect()} == {1: "prose\nnext page", 2: ""}
    pages = spark.createDataFrame([(1, 1, "x" * 121, (0.0, 0.0, 10.0, 10.0)), (1, 2, " ", (0.0, 0.0, 10.0, 10.0)), (1, 3, None, (0.0, 0.0, 10.0, 10.0)), (1, 4, "", (0.0, 0.0, 0.0, 9.0))], f"doc int, page int, text string, box {box}")
    images = spark.createDataFrame([(1, k, (0.0, 0.0, 10.0, 4.5 if k == 2 else 4.0)) for k in range(1, 5)], f"doc int, page int, box {box}")
    assert [tuple(r) for r in layout.image_only_pages(pages, images, "doc").collect()] == [(1, 2)]
    assert tuple(layout.page_text(pages, "doc").first()) == (1, "x" * 121, 4)


def test_portal_lists(spark):
    body = '[{"unique": "A", "name": " Regular ", "numberdate": "20240510"}, {"unique": "B", "name": "x", "numberdate": ""}, {"name": "no id"}, {"unique": "C", "numberdate": "20200101"}, {"unique": "D", "numberdate": "20249999"}]'
    df = spark.createDataFrame([("k", body), ("none", "not json"), ("null", None)], "key string, body string")
    rows = portals.meetings(df, ["key"], since=datetime.date(2023, 1, 1), most=2).collect()
    assert [(r.key, r.unique, r.name, r.day) for r in rows] == [("k", "A", "Regular", datetime.date(2024, 5, 10)), ("k", "B", "x", None)]
    assert [r.unique for r in portals.meetings(df, ["key"]).collect()] == ["A", "B", "C", "D"]
    links = spark.createDataFrame([("https://h/x/$file/a.pdf?open", "A"), ("https://h/x/$file/a.pdf?open", "A"), ("https://h/page", "p")], "target string, link_text string")
    assert [(r.target, r.file_name) for r in portals.agenda_files(links).collect()] == [("https://h/x/$file/a.pdf?open", "a.pdf")]
