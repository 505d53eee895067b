"""Document formats: HTML, DOCX, RTF, policy exports, portals' JSON and sitemaps. Parsers are plain functions; DataFrame
wrappers run them on Arrow batches. PDF needs a library that isn't here, so its parser is passed in."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags without readable text, tags without end, link schemes that lead nowhere, the policy number pattern.
UNREAD = {"script", "style", "noscript", "head", "meta", "link"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NO_PAGE = ("#", "mailto:", "javascript:", "tel:")
POLICY_NUMBER = re.compile(r"^\s*(\d{3,4}(?:\.\d+)*(?:/\d{3,4}(?:\.\d+)*)*)(?:[-.]([A-Za-z][\w().-]*))?\s+(\S.*)$")
LEAST_POLICY = 60


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def find(self, *tags: str) -> list[_Node]:
        out = []
        for c in self.children:
            if isinstance(c, _Node):
                out += [c] if c.tag in tags else []
                out += c.find(*tags)
        return out

    def strings(self, skip: Callable[[_Node], bool] = lambda _: False) -> list[str]:
        out = []
        for c in self.children:
            if isinstance(c, str):
                if c.strip():
                    out.append(c.strip())
            elif c.tag not in UNREAD and not skip(c):
                out += c.strings(skip)
        return out


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str | None) -> _Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def markdown(table: _Node) -> str:
    """A table as a markdown grid with the first row as header; short rows are filled, a pipe in a cell becomes /."""
    rows = []
    for tr in table.find("tr"):
        cells = [" ".join(c.strings()).replace("|", "/").replace("\n", " ") for c in tr.find("th", "td")]
        if cells:
            rows.append(cells)
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join(cells + [""] * (width - len(cells))) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * width, *map(line, rows[1:])])


def html_document(html: str | None) -> tuple[str, list[str]]:
    """(prose, tables as markdown). Tables leave the prose."""
    root = tree(html)
    tables = [m for t in root.find("table") if (m := markdown(t))]
    prose = "\n".join(root.strings(lambda n: n.tag == "table")).replace("\x00", "")
    return "\n".join(x.strip() for x in prose.splitlines() if x.strip()), tables


def links(html: str | None, base: str) -> list[tuple[str, str]]:
    """(absolute URL without fragment, link text) of every link that leads to a page."""
    out = []
    for a in tree(html).find("a"):
        href = a.attrs.get("href", "").strip()
        if href and not href.startswith(NO_PAGE):
            out.append((urljoin(base, href).split("#")[0], " ".join(a.strings())))
    return out


def policies(html: str | None, portal: str = "") -> list[dict]:
    """Sections of a policy manual's export in order. A title without text is kept, and flagged as not substantive."""
    parts = urlsplit(portal)
    book = [p for p in parts.path.split("/") if p]
    base = f"{parts.scheme}://{parts.netloc}/b/{book[1]}" if len(book) >= 2 and book[0] == "b" else f"{parts.scheme}://{parts.netloc}{parts.path.rstrip('/')}" if portal else ""
    classes = lambda n: n.attrs.get("class", "").split()
    out = []
    for div in tree(html).find("div"):
        if "export-section" not in classes(div):
            continue
        heads = [p for p in div.find("p") if "section-title" in classes(p)]
        title = div.attrs.get("data-bookmark-title", "").strip() or (" ".join(heads[0].strings()) if heads else "")
        body = "\n".join(div.strings(lambda n: (n.tag == "p" and "section-title" in classes(n)) or (n.tag == "div" and "section-footer" in classes(n))))
        m, sid = POLICY_NUMBER.match(title), div.attrs.get("id", "").strip()
        out.append({"section_id": sid, "title": title, "number": m[1] if m else None, "suffix": (m[2] or "") if m else "", "text": re.sub(r"\n{3,}", "\n\n", body), "substantive": len(body) >= LEAST_POLICY, "source_url": f"{base}/s/{sid}" if base and sid else portal})
    return out


def docx_text(data: bytes) -> str:
    """Paragraphs of a Word file, one a line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    lines = ("".join(t.text or "" for t in p.iter(f"{ns}t")).strip() for p in root.iter(f"{ns}p"))
    return "\n".join(x for x in lines if x).replace("\x00", "")


_RTF = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|([^\\{}]+)", re.S)
#: Groups whose content isn't text.
_RTF_HIDDEN = set(
    "fonttbl colortbl stylesheet listtable listoverridetable rsidtbl generator info pict themedata colorschememapping latentstyles datastore "
    "xmlnstbl filetbl revtbl upr shppict nonshppict header footer footnote object".split()
)


def rtf_text(raw: str) -> str:
    """Text of an RTF file: control words and hidden groups go, \\par and \\line break lines, \\uN and \\'hh are characters."""
    out: list[str] = []
    stack, hidden, first, fallback = [], False, False, 0
    for word, number, hexa, symbol, brace, text in _RTF.findall(raw):
        if brace == "{":
            stack.append(hidden)
            first = True
            continue
        if brace == "}":
            hidden = stack.pop() if stack else False
        elif symbol == "*" and first:
            hidden = True
        elif word.lower() in _RTF_HIDDEN and first:
            hidden = True
        elif not hidden:
            if word == "u" and number:
                out.append(chr(int(number) % 65536))
                fallback = 1
                first = False
                continue
            if word in ("par", "line", "sect", "page"):
                out.append("\n")
            elif word == "tab":
                out.append("\t")
            elif hexa and not fallback:
                out.append(bytes([int(hexa, 16)]).decode("cp1252", "replace"))
            elif symbol in ("\\", "{", "}"):
                out.append(symbol)
            elif symbol == "~":
                out.append("\u00a0")
            elif text:
                out.append(text.replace("\r", "").replace("\n", "")[fallback:])
        first, fallback = False, 0
    return "\n".join(x.strip() for x in "".join(out).splitlines() if x.strip()).replace("\x00", "")


def json_list(raw: str | None) -> list[dict]:
    """A portal's list, bare or as the first list in an object."""
    try:
        data = json.loads(raw or "")
    except ValueError:
        return []
    if isinstance(data, dict):
        data = next((v for v in data.values() if isinstance(v, list)), [])
    return [x for x in data if isinstance(x, dict)] if isinstance(data, list) else []


def chosen_books(books: list[str]) -> list[str]:
    """Policy books without drafts; if only drafts exist, those; without books, nothing."""
    firm = [b for b in books if not re.search(r"draft|proposed|under review|archiv", b, re.I)]
    return firm or list(books)


def sitemap_urls(xml: Column) -> Column:
    """All <loc> URLs of a sitemap."""
    return F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))


def direct_url(url: Column) -> Column:
    """Viewer links of two hosted office suites as direct downloads."""
    url = F.regexp_replace(url, r"^https://drive\.google\.com/file/d/([^/]+)/.*$", r"https://drive.google.com/uc?export=download&id=$1")
    return F.regexp_replace(url, r"^https://docs\.google\.com/document/d/([^/]+)/.*$", r"https://docs.google.com/document/d/$1/export?format=pdf")


def _mapped(df: DataFrame, column: str, kind: str, out: str, f: Callable) -> DataFrame:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(f)

    return df.withColumn(out, run(F.col(column)))


def with_html(df: DataFrame, html: str = "html") -> DataFrame:
    """df with prose and tables (array of markdown)."""

    def parse(h: str | None) -> dict:
        prose, tables = html_document(h)
        return {"prose": prose, "tables": tables}

    @F.pandas_udf("struct<prose:string,tables:array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([parse(h) for h in s], columns=["prose", "tables"])

    return df.withColumn("__d", run(F.col(html))).withColumns({"prose": F.col("__d.prose"), "tables": F.col("__d.tables")}).drop("__d")


def with_links(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row a link of each page: the columns of df without the HTML, target, link_text."""

    @F.pandas_udf("array<struct<target:string,link_text:string>>")
    def run(htmls: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([[{"target": t, "link_text": x} for t, x in links(h, u or "")] for h, u in zip(htmls, urls, strict=True)])

    others = [c for c in df.columns if c != html]
    return df.withColumn("__l", F.explode(run(F.col(html), F.col(url)))).select(*others, "__l.*")


def with_policies(df: DataFrame, html: str = "html", portal: str = "") -> DataFrame:
    kind = "array<struct<section_id:string,title:string,number:string,suffix:string,text:string,substantive:boolean,source_url:string>>"
    others = [c for c in df.columns if c != html]
    return _mapped(df, html, kind, "__p", lambda h: policies(h, portal)).select(*others, F.explode("__p").alias("p")).select(*others, "p.*")


def extract(files: DataFrame, parsers: dict[str, Callable[[bytes], tuple[str, list[str]]]] | None = None) -> DataFrame:
    """Text and tables of binary files (path, content) by suffix; a suffix without parser gives an error text."""
    known = {
        ".html": lambda b: html_document(b.decode("utf-8", "replace")), ".htm": lambda b: html_document(b.decode("utf-8", "replace")),
        ".docx": lambda b: (docx_text(b), []), ".rtf": lambda b: (rtf_text(b.decode("latin-1")), []), ".txt": lambda b: (b.decode("utf-8", "replace"), []),
    } | (parsers or {})

    @F.pandas_udf("struct<text:string,tables:array<string>,error:string>")
    def run(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for p, data in zip(paths, contents, strict=True):
            suffix = "." + p.rsplit(".", 1)[-1].lower()
            try:
                text, tables = known[suffix](data)
                rows.append((text, tables, None))
            except KeyError:
                rows.append((None, [], f"no parser for {suffix}"))
            except Exception as e:
                rows.append((None, [], f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(rows, columns=["text", "tables", "error"])

    return files.withColumn("__d", run("path", "content")).select("path", "__d.*")


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
