"""Documents to chunks: word windows that end at sentences, outline sections, whole tables.

The walks are sequential within one document, so they run as Arrow-batched functions that return arrays; everything
around them is columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import meeting_date
from millrace.functions.taxonomy import doc_type_of_title

# Sizes in words and characters, and the two outline patterns.
WORDS, OVERLAP, SNAP = 400, 50, 40
INTRO_MIN, WHOLE_MAX, SPLIT_OVER, TABLE_MAX = 250, 1600, 3200, 24_000
TOP_ITEM, LETTER_ITEM = re.compile(r"^(\d{1,2})\.\s+(\S.*)$"), re.compile(r"^([A-Z])\.\s+(\S.*)$")
LEAST_CHARS = {"prose": 40, "pdf": 200, "html": 1}


def windows(words: list[str], size: int = WORDS, overlap: int = OVERLAP, snap: int = SNAP) -> list[tuple[int, int]]:
    """Word spans of at most `size` words. An inner end moves to the nearest sentence end within `snap` words, the earlier of two
    equally near; a sentence ends with a word whose last character is one of . ! ?"""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, and overlap in [0, size)")
    n, spans, start = len(words), [], 0
    while start < n:
        ideal = min(start + size, n)
        end = ideal
        if ideal < n:
            ends = [i for i in range(max(start + 1, ideal - snap), min(n, ideal + snap)) if words[i - 1][-1] in ".!?"]
            end = min(ends, key=lambda i: (abs(i - ideal), i), default=ideal)
        spans.append((start, end))
        if end >= n:
            break
        start = max(end - overlap, start + size - overlap)
    return spans


def window_chunks(docs: DataFrame, text: str = "text", size: int = WORDS, overlap: int = OVERLAP) -> DataFrame:
    """One row a window: the columns of docs without the text, chunk_index, word_start, word_end, content."""

    @F.pandas_udf("array<struct<chunk_index:int,word_start:int,word_end:int,content:string>>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = []
            for t in s:
                words = (t or "").split()
                out.append([{"chunk_index": i, "word_start": a, "word_end": b, "content": " ".join(words[a:b])} for i, (a, b) in enumerate(windows(words, size, overlap))])
            yield pd.Series(out)

    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.explode(cut(F.col(text))).alias("c")).select(*others, "c.*")


def outline(text: str) -> list[dict]:
    """Segments of an agenda: a header, numbered parts that continue the count, lettered items below a part."""
    part, kind = 0, "Header"
    segments = [{"level": -1, "path": ["header"], "type": "Header", "heading": "", "lines": []}]
    for line in map(str.strip, (text or "").splitlines()):
        top, letter = TOP_ITEM.match(line), LETTER_ITEM.match(line)
        if top and int(top[1]) == part + 1:
            part, kind = part + 1, top[2].strip()
            segments.append({"level": 0, "path": [f"P{part}"], "type": kind, "heading": kind, "lines": []})
        elif letter and part:
            segments.append({"level": 1, "path": [f"P{part}", letter[1]], "type": kind, "heading": letter[2].strip(), "lines": []})
        elif line:
            segments[-1]["lines"].append(line)
    for s in segments:
        s["text"] = "\n".join(x for x in ([s["heading"]] if s["level"] >= 0 else []) + s["lines"] if x).strip()
    return [s for s in segments if s["text"]]


def _pieces(content: str) -> list[str]:
    if len(content) <= SPLIT_OVER:
        return [content]
    words = content.split()
    return [" ".join(words[a:b]) for a, b in windows(words)]


def sections(text: str) -> list[dict]:
    """Chunks of an agenda. Consent agendas split at every letter, other parts only beyond WHOLE_MAX characters; a short
    introduction joins the first letter; what is over SPLIT_OVER is cut into windows with #1, #2 ... at its path."""
    parts: list[list[dict]] = []
    for s in outline(text):
        if s["level"] <= 0 or not parts:
            parts.append([s])
        else:
            parts[-1].append(s)
    found: list[tuple[str, str, str, str]] = []
    for head, *rest in parts:
        whole = "\n\n".join(s["text"] for s in (head, *rest))
        if not rest or (len(whole) <= WHOLE_MAX and "consent agenda" not in head["type"].lower()):
            found.append((whole, ".".join(head["path"]), head["type"], head["heading"] or head["type"]))
            continue
        lead = head["text"] if len(head["text"]) < INTRO_MIN else ""
        if head["text"] and not lead:
            found.append((head["text"], ".".join(head["path"]), head["type"], head["heading"]))
        for i, s in enumerate(rest):
            body = f"{lead}\n\n{s['text']}".strip() if lead and i == 0 else s["text"]
            found.append((body, ".".join(s["path"]), s["type"], s["heading"]))
    out = []
    for content, path, kind, heading in found:
        pieces = _pieces(content)
        for i, p in enumerate(pieces):
            out.append({"chunk_index": len(out), "section_path": path if len(pieces) == 1 else f"{path}#{i + 1}", "section_type": kind, "heading": heading, "content": p})
    return out


def section_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a section chunk: the columns of docs without the text, chunk_index, section_path, section_type, heading, content."""

    @F.pandas_udf("array<struct<chunk_index:int,section_path:string,section_type:string,heading:string,content:string>>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(sections)

    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.explode(cut(F.col(text))).alias("c")).select(*others, "c.*")


def table_chunks(docs: DataFrame, tables: str = "tables", after: Column | None = None) -> DataFrame:
    """One row a table (array of page and markdown), path T{page}#{i of the page}; the index goes on after all prose chunks."""
    after = F.lit(0) if after is None else after
    others = [c for c in docs.columns if c != tables]
    rows = docs.select(*others, after.alias("__after"), F.col(tables).alias("__t"), F.posexplode(tables).alias("i", "t"))
    before = F.size(F.filter(F.slice("__t", F.lit(1), F.col("i") + 1), lambda x: x["page"] == F.col("t.page")))
    path = F.concat(F.lit("T"), F.col("t.page").cast("string"), F.lit("#"), before.cast("string"))
    return rows.select(*others, (F.col("__after") + F.col("i")).cast("int").alias("chunk_index"), path.alias("section_path"), F.substring(F.col("t.markdown"), 1, TABLE_MAX).alias("content"), F.lit("table").alias("kind"))


def prepared(docs: DataFrame) -> DataFrame:
    """docs (title, text, doc_type, date) with the meeting date of title, else of the first 2000 characters, else the manifest's; a type of other is judged by the title."""
    day = F.coalesce(meeting_date(F.col("title")), meeting_date(F.substring("text", 1, 2000)), F.col("date"))
    kind = F.when(F.col("doc_type") == "other", doc_type_of_title(F.col("title"))).otherwise(F.col("doc_type"))
    return docs.withColumns({"meeting_date": day, "doc_type": kind})


def large_enough(docs: DataFrame, kind: Column, text: str = "text") -> DataFrame:
    """Documents with enough text for their kind."""
    least = F.when(kind == "pdf", LEAST_CHARS["pdf"]).when(kind == "html", LEAST_CHARS["html"]).otherwise(LEAST_CHARS["prose"])
    return docs.where(F.char_length(F.coalesce(F.col(text), F.lit(""))) >= least)


def pipe_tables(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Runs of two or more lines that start with | and hold two, as (key, first_line, n_lines, markdown): gaps and islands in each page's own array."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    is_row = lambda x: F.trim(x).startswith("|") & (F.char_length(x) - F.char_length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    rows = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), is_row(x).alias("row"), x.alias("line"))), lambda s: s["row"])
    # A row's line number less its place among the rows is the same along a run.
    named = F.transform(rows, lambda s, j: F.struct((s["i"] - j).alias("run"), s["i"].alias("i"), s["line"].alias("line")))
    runs = F.transform(F.array_distinct(F.transform(named, lambda s: s["run"])), lambda r: F.filter(named, lambda s: s["run"] == r))
    tables = F.filter(runs, lambda r: F.size(r) >= 2)
    out = pages.select(key, F.explode(tables).alias("r"))
    return out.select(key, F.col("r")[0]["i"].alias("first_line"), F.size("r").alias("n_lines"), F.trim(F.array_join(F.transform("r", lambda s: s["line"]), "\n")).alias("markdown"))


def prose_without_tables(text: Column) -> Column:
    """A page's text without the rows of its tables; a single row stays."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    is_row = lambda x: F.trim(x).startswith("|") & (F.char_length(x) - F.char_length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    flags = F.transform(lines, lambda x: is_row(x))
    near = lambda i: F.coalesce(F.get(flags, i - 1), F.lit(False)) | F.coalesce(F.get(flags, i + 1), F.lit(False))
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~(is_row(x) & near(i)), x)), lambda x: x.isNotNull())
    return F.trim(F.array_join(kept, "\n"))


def section_tree(chunks: DataFrame, key: str, path: str = "section_path") -> DataFrame:
    """Every section of each document, those that only have parts included: path, parent (null at the top) and level. Paths are numbers and letters joined by points."""
    parts = F.split(path, r"\.")
    ways = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.slice(parts, F.lit(1), n))
    rows = chunks.where(F.col(path).isNotNull() & (F.col(path) != "")).select(key, F.explode(ways).alias("__way"))
    parent = F.when(F.size("__way") > 1, F.array_join(F.slice("__way", F.lit(1), F.size("__way") - 1), "."))
    return rows.select(key, F.array_join("__way", ".").alias("path"), parent.alias("parent"), F.size("__way").alias("level")).distinct()
