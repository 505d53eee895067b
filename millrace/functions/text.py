"""Text quality, classification, cleaning and citation checks as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the content classes, the procedural families, label refusals, and the Spanish word list.
PRICE = r"(?i)\$\s?\d|cents?\b|per\s+annum|dollars?\b|shillings?\b"
AD_KEYWORDS = r"(?i)\bFOR\s+SALE\b|\bWANTED\b|\bTO\s+LET\b|\bAUCTION\b|\bREWARD\b|\bAPPLY\s+(TO|AT)\b|\bPRICE\b|\bDISSO(LU|LV)TION\b"
LEGAL = r"(?i)NOTICE\s+IS\s+HEREBY\s+GIVEN|IN\s+PURSUANCE\s+OF|BY\s+ORDER\s+OF|SUPREME\s+COURT|CHANCERY|CHANCELLOR|\bMORTGAGE\b|\bFORECLOSURE\b|\bPURSUANT\s+TO\s+STATUTE\b|\bSURROGATE\b"
#: Per family its patterns, each with words in lower case without one of which it can't match: they are looked for first.
FAMILY_PARTS = {
    "rollcall": [(["roll"], r"\broll\s*call\b"), (["member"], r"\bmembers?\s+present\b"), (["present", "absent"], r"\b(present|absent)\s*[:\-—]")],
    "motion": [
        (["motion"], r"\bmotion\s+(by|to|was|made|carried)\b"), (["seconded"], r"\bseconded\s+by\b"), (["moved"], r"\bmoved\s+by\b"), (["motion"], r"\bupon\s+a\s+motion\b"), (["favor"], r"\ball\s+in\s+favor\b"),
        (["unanimously"], r"\bcarried\s+unanimously\b"), (["aye"], r"\bayes?\s*[:\-—]"), (["nay"], r"\bnays?\s*[:\-—]"), (["abstention"], r"\babstentions?\b"),
    ],
    "minutes": [(["minutes"], r"\bapproval\s+of\s+(the\s+)?minutes\b"), (["minutes"], r"\bminutes\s+of\s+the\b[^.]{0,40}\bmeeting\b"), (["agenda"], r"\bconsent\s+agenda\b")],
    "logistics": [
        (["order"], r"\bcall\s+to\s+order\b"), (["adjourn"], r"\badjourn(ed|ment|s)?\b"), (["allegiance"], r"\bpledge\s+of\s+allegiance\b"), (["executive"], r"\bexecutive\s+session\b"),
        (["public"], r"\bpublic\s+(comment|participation)\b"), (["meeting"], r"\bnext\s+(regular\s+)?(meeting|board\s+meeting)\b"), (["order", "information"], r"\bpoint\s+of\s+(order|information)\b"),
    ],
}
FAMILIES = {k: "(?i)" + "|".join(p for _, p in parts) for k, parts in FAMILY_PARTS.items()}
REFUSALS = [
    r"^i cannot\b", r"^i'?m unable\b", r"^unable to\b", r"^the passages\b.*\b(do not|don't)\b", r"\bocr[- ]?(damaged|corrupted|errors?)\b",
    r"\bseverely corrupted\b", r"\bcannot reliably\b", r"\bunintelligible\b", r"\bno (clear|shared|coherent)\b", r"^unclear\b",
]
SPANISH = (
    "de la que el en y a los del se las por un para con no una su al es lo como más pero sus le ya o este sí porque esta entre cuando todo también "
    "fue había año años muy dos ser son hasta desde está están nuestra nuestro nuestros escuela escuelas distrito junta educación estudiantes "
    "estudiante estudiantil presupuesto escolar reunión propone suma impuestos misión visión aprendizaje enseñanza logro grados resultados "
    "matemáticas ciencias seguridad edificios votación papeleta comunidad familias maestros programa servicios reflejan mantener excelencia"
).split()
CONTROLS = r"[\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff\x00-\x08\x0b\x0c\x0e-\x1f]"
CLEAN_NUMBER = r"(?<!\S)[($]?-?[\d,]+(?:\.\d+)*\)?%?(?!\S)"
MONEY = r"\$\s?\d"
WORD_EDGES, TOKEN_EDGES = ".,;:!?\"'()-", ".,;:!?\"'()[]{}*/&%$#=+–—•"
CONTENT, AD, LEGAL_NOTICE, BAD_OCR = 0, 1, 2, 3

#: A small list of frequent English words of our own; pass another for other corpora.
ENGLISH = (
    "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were all her she there would "
    "their we him been has when who will no more if out so said what up its about than into them can only other time new some could these two may "
    "first then do any like my now over such our man me even most made after also did many off before must well back through years where much your "
    "way down should because long each just state people those too mr how little good world make very year still see own work men day get here "
    "between both life being under three never know same last another while us might great go come since against right came take used himself few "
    "house use during without again place around however home small found thought went say part once general high upon school every does"
).split()


def words(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


SLICE = 64  # texts that a task holds as Python strings


def _each_text(texts: Iterator[pa.Array], form: Callable[[str], str]) -> Iterator[pa.Array]:
    """Texts one by one, a few at once as Python strings: beside Arrow's buffers nothing grows with the batch."""
    for batch in texts:
        done = [pa.array([None if t is None else form(t) for t in batch.slice(at, SLICE).to_pylist()], pa.string()) for at in range(0, len(batch), SLICE)]
        yield pa.concat_arrays(done) if done else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def _nfc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _each_text(texts, lambda t: unicodedata.normalize("NFC", t))


@F.arrow_udf(T.StringType())
def _nfkc_casefold(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _each_text(texts, lambda t: unicodedata.normalize("NFKC", t).casefold())


def nfc(text: Column) -> Column:
    """Unicode NFC; Spark has no built-in. Characters before U+0300 neither compose nor decompose: only texts with others leave the JVM."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\u02ff]"), text)), text)


def nfkc_casefold(text: Column) -> Column:
    """NFKC, case folded; of ASCII that is the lower case."""
    return F.coalesce(_nfkc_casefold(F.when(text.rlike(r"[^\x00-\x7f]"), text)), F.lower(text))


def clean_ocr(text: Column) -> Column:
    """Line breaks stay; control characters go, runs of blanks become one, three or more line breaks two."""
    s = F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), r"[\x00-\x08\x0b-\x1f]", "")
    s = F.regexp_replace(s, r"[ \t\f\x0b]+", " ")
    s = F.regexp_replace(s, r"\n\s*\n\s*(\n\s*)+", "\n\n")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def _known(word_list: list[str]) -> Column:
    return F.lit(sorted(set(word_list)))


def known_words(text: Column, word_list: list[str], edges: str) -> Column:
    """How many tokens are words of the list, in lower case and without the edge characters around them. The text is cut once, edges and white space together."""
    edge = "[" + re.sub(r"([\[\]\\^&-])", r"\\\1", edges) + "]"
    cut = rf"(?![a-z0-9])(?:\s++{edge}*+|(?={edge})(?:(?<!{edge}){edge}++(?:\s++{edge}*+|\z)|\A{edge}++))"  # most characters are passed over at once
    return F.size(F.filter(F.split(F.lower(text), cut), lambda w: w.isin(word_list)))


def token_count(text: Column) -> Column:
    """As many as `words` has."""
    return F.regexp_count(text, F.lit(r"\S+"))


def token_characters(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"\s+", ""))


def letters(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"\P{L}", ""))


def with_quality(df: DataFrame, text: str = "text", word_list: list[str] = ENGLISH) -> DataFrame:
    """df with non_alpha_ratio, avg_word_len, dict_word_ratio, word_count and quality_score; a blank text has 1, 0, 0, 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"word_count": token_count(t), "__chars": token_characters(t), "__known": known_words(t, word_list, WORD_EDGES), "__letters": letters(t), "__bare": F.char_length(F.regexp_replace(t, r"[ \t\n]", ""))})
    n, bare = F.col("word_count"), F.col("__bare")
    df = df.withColumns({
        "non_alpha_ratio": F.when((n > 0) & (bare > 0), 1 - F.try_divide("__letters", bare)).otherwise(1.0),
        "avg_word_len": F.when(n > 0, F.try_divide("__chars", n)).otherwise(0.0),
        "dict_word_ratio": F.when(n > 0, F.try_divide("__known", n)).otherwise(0.0),
    })
    return df.withColumn("quality_score", composite()).drop("__chars", "__known", "__letters", "__bare")


def weak() -> Column:
    return (F.col("avg_word_len") < 2) | (F.col("avg_word_len") > 16) | (F.col("non_alpha_ratio") > 0.5)


def composite() -> Column:
    length = F.when((F.col("avg_word_len") < 2) | (F.col("avg_word_len") > 16), 0.5).otherwise(1.0)
    signs = F.when(F.col("non_alpha_ratio") > 0.5, 0.5).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dict_word_ratio") * length * signs))


def with_verdict(df: DataFrame, old_reason: str | None = None) -> DataFrame:
    """df with status and reason by the quality columns. A chunk that a cluster refused stays quarantined."""
    ratio = F.col("dict_word_ratio")
    reason = F.when(F.col("word_count") < 3, "too_short").when((ratio < 0.18) | ((ratio < 0.28) & weak()), "ocr_illegible").when(ratio < 0.40, "reassignment_candidate")
    status = F.when((F.col("word_count") < 3) | (ratio < 0.18) | ((ratio < 0.28) & weak()), "quarantined").otherwise("active")
    if old_reason:
        refused = F.coalesce(F.col(old_reason) == "cluster_refused", F.lit(False))
        reason, status = F.when(refused, "cluster_refused").otherwise(reason), F.when(refused, "quarantined").otherwise(status)
    return df.withColumns({"status": status, "reason": reason})


def _class(t: Column, n: Column, chars: Column, known: Column) -> Column:
    bare = F.char_length(F.replace(t, F.lit(" "), F.lit("")))
    mean, share = F.try_divide(chars, n), F.try_divide(known, n)
    bad = (n == 0) | ((n >= 5) & ((F.try_divide(letters(t), bare) < 0.6) | (mean < 2) | (mean > 15) | (share < 0.3)))
    ad = ((n < 80) & t.rlike(PRICE)) | t.rlike(AD_KEYWORDS)
    return F.when(bad, BAD_OCR).when(F.regexp_count(t, F.lit(LEGAL)) >= 2, LEGAL_NOTICE).when(ad, AD).otherwise(CONTENT)


def content_class(text: Column, word_list: list[str] = ENGLISH) -> Column:
    """0 content, 1 ad, 2 legal, 3 bad OCR; the first that holds of bad OCR, legal, ad."""
    t = F.coalesce(text, F.lit(""))
    return _class(t, token_count(t), token_characters(t), known_words(t, word_list, WORD_EDGES))


def with_content_class(df: DataFrame, text: str = "text", out: str = "class", word_list: list[str] = ENGLISH) -> DataFrame:
    """df with `content_class`; what several conditions ask for is a column and computed once."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"__n": token_count(t), "__chars": token_characters(t), "__known": known_words(t, word_list, WORD_EDGES)})
    return df.withColumn(out, _class(t, F.col("__n"), F.col("__chars"), F.col("__known"))).drop("__n", "__chars", "__known")


def _meaningful(t: Column, n: Column, word_list: list[str] | None) -> Column:
    known = sorted({w for w in (word_list if word_list is not None else ENGLISH + SPANISH) if len(w) >= 2})
    good = known_words(t, known, TOKEN_EDGES) + F.regexp_count(t, F.lit(r"(?=[($\d,-])" + CLEAN_NUMBER))
    return F.when(n >= 5, F.try_divide(good, n))


def meaningful_fraction(text: Column, word_list: list[str] | None = None) -> Column:
    """Share of tokens that are known words or clean numbers; null below five tokens."""
    t = without_controls(F.coalesce(text, F.lit("")))
    return _meaningful(t, token_count(t), word_list)


def without_controls(text: Column) -> Column:
    """Printable ASCII is passed over before the controls are compared."""
    return F.regexp_replace(text, r"(?![ -~])" + CONTROLS, "")


def _families(t: Column, lower: Column) -> Column:
    either = lambda columns: reduce(lambda a, b: a | b, columns)
    shows = (either(either(lower.contains(w) for w in words) & t.rlike(f"(?i){p}") for words, p in parts) for parts in FAMILY_PARTS.values())
    return reduce(lambda a, b: a + b, (x.cast("int") for x in shows))


def families(text: Column) -> Column:
    """How many procedural families a text shows."""
    t = F.coalesce(text, F.lit(""))
    return _families(t, F.lower(t))


def with_chunk_verdict(df: DataFrame, text: str = "text", word_list: list[str] | None = None) -> DataFrame:
    """df with meaningful, families, status, reason and quality_score: garbled, then too short, then procedural."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"__clean": without_controls(t), "__lower": F.lower(t)}).withColumns({"families": _families(t, F.col("__lower")), "__n": token_count(F.col("__clean"))})
    df = df.withColumn("meaningful", _meaningful(F.col("__clean"), F.col("__n"), word_list))
    share, hits, n = F.col("meaningful"), F.col("families"), F.col("__n")
    reason = F.when(share < 0.25, "garbled").when((n < 8) & ~t.rlike(MONEY), "too_short").when((n <= 180) & (hits >= 2), "procedural")
    base = F.least(F.lit(1.0), F.coalesce(share, F.lit(0.6))) * F.when((hits == 1) & (n <= 180), 0.85).otherwise(1.0)
    df = df.withColumn("reason", reason)
    score = F.when(F.col("reason") == "garbled", F.round(share, 3)).when(F.col("reason").isNotNull(), 0.2).otherwise(F.round(base, 3))
    return df.withColumns({"status": F.when(F.col("reason").isNull(), "active").otherwise("quarantined"), "quality_score": score}).drop("__n", "__clean", "__lower")


def slug(text: Column, most: int = 120) -> Column:
    s = F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), F.lit("-._"))
    return F.when(s == "", "untitled").otherwise(F.substring(s, 1, most))


def extension(name: Column) -> Column:
    """A file name's suffix, if it is plausible."""
    return F.regexp_extract(F.lower(F.trim(name)), r"(\.[a-z0-9]{1,8})$", 1)


def file_name(url: Column) -> Column:
    return F.try_url_decode(F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1))


def citations(answer: Column) -> Column:
    """Distinct numbers cited as [n], ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))))


def bad_citations(answer: Column, n: Column) -> Column:
    """Cited numbers outside 1 to n."""
    return F.filter(citations(answer), lambda c: (c < 1) | (c > n))


def is_refusal(answer: Column, phrase: str) -> Column:
    """The phrase without a citation."""
    return F.lower(answer).contains(phrase.lower()) & ~answer.rlike(r"\[\d+\]")


def is_label_refusal(label: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.trim(label).rlike(f"(?i){p}") for p in REFUSALS))


def embedding_prefix(district: Column, day: Column, section: Column, heading: Column) -> Column:
    """"district · date · section › heading" to stand before a chunk's text."""
    where = F.when(F.coalesce(heading, F.lit("")).isin("") | (heading == section), section).otherwise(F.concat_ws(" › ", section, heading))
    return F.concat_ws(" · ", district, F.coalesce(day.cast("string"), F.lit("undated")), F.nullif(where, F.lit("")))


def normal_form(text: Column) -> Column:
    """For matching quotes: NFKC, no-break spaces as spaces, runs of white space as one, case folded."""
    return F.trim(F.regexp_replace(nfkc_casefold(F.coalesce(text, F.lit(""))), r"[\s\u00a0]+", " "))
