"""Full-text search: web-style queries over token arrays, exact-token ranks, and cover-density ranks.

Cover-density ranks come from postings with positions: a row for each place of a query's words, and windows over a text's
places in order. Nothing leaves the JVM, and only the query's words are shuffled, not texts.

Tokens are runs of letters and digits, lower-cased, without stop words, stemmed on request by a light suffix stripper
of our own. It isn't the Snowball stemmer, so ranks agree with a database's in kind, not to the digit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A short English stop list.
STOP = "a an and are as at be but by for from has have he her his i in is it its of on or our she that the their they this to was we were will with you".split()


ENDINGS = [("sses", "ss"), ("ies", "y"), ("ing", ""), ("edly", ""), ("ed", ""), ("ly", ""), ("ss", "ss"), ("s", "")]


def stem(word: str) -> str:
    """Plural, participle and adverb endings off, as long as three letters stay."""
    for ending, rest in ENDINGS:
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            return word[: len(word) - len(ending)] + rest
    return word


def tokenize(text: str | None, stemmed: bool = False) -> list[str]:
    found = re.findall(r"[^\W_]+", (text or "").lower())
    return [stem(w) if stemmed else w for w in found]


@dataclass
class Query:
    """Alternatives of clauses: each clause a phrase (one word or more) that must, or must not, occur."""

    alternatives: list[list[tuple[bool, list[str]]]] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not any(any(wanted for wanted, _ in a) for a in self.alternatives)


def parse(text: str, stemmed: bool = False) -> Query:
    """Words are joined by and, "…" is a phrase, `or` separates alternatives, - negates. Stop words fall away; nothing left matches nothing."""
    alternatives: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus:
            alternatives.append([])
            continue
        tokens = [t for t in tokenize(phrase if phrase else word, stemmed) if t not in STOP]
        if tokens:
            alternatives[-1].append((not minus, tokens))
    return Query([a for a in alternatives if a])


def token_array(text: Column) -> Column:
    """Tokens as the JVM finds them: letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def matches(tokens: Column, query: Query) -> Column:
    """Whether unstemmed tokens satisfy the query. Phrases skip no token, stop words aside."""
    bare = F.filter(tokens, lambda t: ~t.isin(STOP))
    joined = F.concat(F.lit(" "), F.array_join(bare, " "), F.lit(" "))
    has = lambda phrase: joined.contains(f" {' '.join(phrase)} ")
    out = F.lit(False)
    for clauses in query.alternatives:
        every = F.lit(any(wanted for wanted, _ in clauses))
        for wanted, phrase in clauses:
            every = every & (has(phrase) if wanted else ~has(phrase))
        out = out | every
    return out


def frequency_rank(tokens: Column, query: Query) -> Column:
    """Occurrences of the wanted words."""
    wanted = sorted({t for a in query.alternatives for w, phrase in a if w for t in phrase})
    return F.size(F.filter(tokens, lambda t: t.isin(wanted)))


def search(docs: DataFrame, text: str, query: str, most: int = 60, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """Every mention: matching rows by rank, 200 at most."""
    q = parse(query)
    rows = docs.withColumn("__t", token_array(F.col(column)))
    hits = rows.where(F.lit(False) if q.empty else matches(F.col("__t"), q))
    return hits.withColumn("rank", frequency_rank(F.col("__t"), q)).drop("__t").orderBy(F.desc("rank"), id_col).limit(min(most, 200))


def covers(places: list[tuple[int, str]], wanted: set[str]) -> list[tuple[int, int]]:
    """Shortest spans that hold every wanted word, none inside another."""
    out: list[tuple[int, int]] = []
    last: dict[str, int] = {}
    for at, word in places:
        if word in wanted:
            last[word] = at
            if len(last) == len(wanted):
                start = min(last.values())
                if not out or start > out[-1][0]:
                    out.append((start, at))
    return out


def satisfied(tokens: list[str], clauses: list[tuple[bool, list[str]]]) -> bool:
    """Whether the tokens hold every wanted phrase of an alternative and none that it negates. Phrases skip no token, stop words aside."""
    joined = f" {' '.join(t for t in tokens if t not in STOP)} "
    return any(w for w, _ in clauses) and all((f" {' '.join(phrase)} " in joined) == w for w, phrase in clauses)


def cover_density(text: str | None, query: Query, stemmed: bool = True) -> float:
    """Cover density (Clarke, Cormack and Tudhope 2000) of the alternatives that the text satisfies: each cover gives the number of words over its length, a tenth a word."""
    tokens = tokenize(text, stemmed)
    places = list(enumerate(tokens, 1))
    score = 0.0
    for clauses in query.alternatives:
        wanted = {t for w, phrase in clauses if w for t in phrase}
        if satisfied(tokens, clauses):
            score += sum(0.1 * len(wanted) / max(1, b - a + 2 - len(wanted)) for a, b in covers(places, wanted))
    return score


def stem_column(word: Column) -> Column:
    """`stem` as an expression."""
    n, out = F.char_length(word), F
    for ending, rest in ENDINGS:
        out = out.when(word.endswith(ending) & (n - len(ending) >= 3), F.concat(F.substring(word, F.lit(1), n - len(ending)), F.lit(rest)))
    return out.otherwise(word)


def stop_tokens(stemmed: bool) -> list[str]:
    """Tokens that fall away: the stop words, or all that a stem makes one."""
    if not stemmed:
        return STOP
    return sorted({t for w in STOP for ending, rest in [("", ""), *ENDINGS] if w.endswith(rest) and stem(t := w[: len(w) - len(rest)] + ending) in STOP})


def words_of(query: Query) -> list[str]:
    return sorted({t for clauses in query.alternatives for _, phrase in clauses for t in phrase})


def postings(docs: DataFrame, words: list[str], id_col: str = "doc_id", column: str = "text", stemmed: bool = True) -> DataFrame:
    """(id, term, place, at) of every occurrence of the words: `at` counts all tokens from 1, `place` those that aren't stop words. id_col is unique; texts without any of the words aren't split."""
    # A token that becomes a word begins with it, but for a last y, which may stand for ies.
    hints = sorted({w.removesuffix("y") if stemmed else w for w in words})
    some = F.lower(F.col(column)).rlike("|".join(map(re.escape, hints))) if words else F.lit(False)
    tokens = F.transform(token_array(F.col(column)), lambda t, i: F.struct((i + 1).alias("at"), t.alias("token")))
    rows = docs.where(some).select(F.col(id_col), F.posexplode(F.filter(tokens, lambda x: ~x["token"].isin(stop_tokens(stemmed)))).alias("place", "x"))
    near = reduce(lambda a, b: a | b, (F.col("x.token").startswith(h) for h in hints), F.lit(False))
    term = stem_column(F.col("x.token")) if stemmed else F.col("x.token")
    return rows.where(near).select(id_col, term.alias("term"), "place", F.col("x.at").alias("at")).where(F.col("term").isin(words))


def cover_ranks(found: DataFrame, query: Query, id_col: str = "doc_id") -> DataFrame:
    """(id, cover_rank) of the texts that match, from the postings of the query's words, as `cover_density` has it.

    A cover ends where the last places of all wanted words are known and the least of them has moved on."""
    order = Window.partitionBy(id_col).orderBy("place")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    starts, scores, held = {}, {}, {}
    for k, clauses in enumerate(query.alternatives):
        wanted = sorted({t for w, phrase in clauses if w for t in phrase})
        if not wanted:
            continue
        lasts = [F.last(F.when(F.col("term") == w, F.col("at")), ignorenulls=True).over(so_far) for w in wanted]
        known = reduce(lambda a, b: a & b, (c.isNotNull() for c in lasts))
        starts[f"start{k}"] = F.when(known, F.least(*lasts) if len(lasts) > 1 else lasts[0])
        start, before = F.col(f"start{k}"), F.lag(f"start{k}").over(order)
        new = start.isNotNull() & (before.isNull() | (start > before))
        scores[f"cover{k}"] = F.when(new, 0.1 * len(wanted) / F.greatest(F.lit(1), F.col("at") - start + 2 - len(wanted)))
        for j, (_, phrase) in enumerate(clauses):
            here = [(F.lead("term", i).over(order) == t) & (F.lead("place", i).over(order) == F.col("place") + i) if i else F.col("term") == t for i, t in enumerate(phrase)]
            held[f"held{k}_{j}"] = F.coalesce(reduce(lambda a, b: a & b, here), F.lit(False))
    if not scores:
        return found.select(id_col, F.lit(0.0).alias("cover_rank")).limit(0)
    rows = found.withColumns(starts).withColumns(scores | held)
    texts = rows.groupBy(id_col).agg(*(F.sum(c).alias(c) for c in scores), *(F.max(c).alias(c) for c in held))
    total = F.lit(0.0)
    for k, clauses in enumerate(query.alternatives):
        if f"cover{k}" in scores:
            fits = reduce(lambda a, b: a & b, (F.col(f"held{k}_{j}") if w else ~F.col(f"held{k}_{j}") for j, (w, _) in enumerate(clauses)))
            total = total + F.when(fits, F.coalesce(f"cover{k}", F.lit(0.0))).otherwise(0.0)
    return texts.select(id_col, total.alias("cover_rank")).where("cover_rank > 0")


def ranked_by_cover(docs: DataFrame, query: str, column: str = "text", stemmed: bool = True, id_col: str = "doc_id") -> DataFrame:
    """(id, cover_rank) of the docs that match the query, phrases and negations included."""
    q = parse(query, stemmed)
    return cover_ranks(postings(docs.select(id_col, column), words_of(q), id_col, column, stemmed), q, id_col)


def cover_sql(query: Query, table: str = "documents", stemmed: bool = True) -> str:
    """`ranked_by_cover` as SQL: doc_id and cover_rank of the texts that match."""
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    cases = " ".join(f"when x.token like '%{e}' and length(x.token) - {len(e)} >= 3 then x.token[:length(x.token) - {len(e)}] || '{rest}'" for e, rest in ENDINGS)
    starts, covers_, held, total = [], [], [], []
    for k, clauses in enumerate(query.alternatives):
        wanted = sorted({t for w, phrase in clauses if w for t in phrase})
        lasts = [f"last_value(case when term = '{w}' then pos end ignore nulls) over o" for w in wanted]
        starts.append(f"case when {' and '.join(f'{c} is not null' for c in lasts)} then least({', '.join(lasts)}) end as start{k}")
        covers_.append(f"sum(case when start{k} is not null and (before{k} is null or start{k} > before{k}) then {0.1 * len(wanted)!r}::double / greatest(1, pos - start{k} + {2 - len(wanted)}) end) as cover{k}")
        for j, (_, phrase) in enumerate(clauses):
            here = [f"(lead(term, {i}) over n = '{t}' and lead(place, {i}) over n = place + {i})" for i, t in enumerate(phrase)]
            held.append((f"coalesce({' and '.join(here)}, false) as held{k}_{j}", f"bool_or(held{k}_{j}) as held{k}_{j}"))
        fits = " and ".join(f"{'' if w else 'not '}held{k}_{j}" for j, (w, _) in enumerate(clauses))
        total.append(f"case when {fits} then coalesce(cover{k}, 0) else 0 end")
    befores = ", ".join(f"lag(start{k}) over n as before{k}" for k in range(len(starts)))
    return f"""
        select doc_id, cover_rank from (
            select doc_id, {' + '.join(total)} as cover_rank from (
                select doc_id, {', '.join(covers_)}, {', '.join(b for _, b in held)} from (
                    select *, {befores}, {', '.join(a for a, _ in held)} from (
                        select *, {', '.join(starts)} from (
                            select doc_id, place, x.pos as pos, {f"case {cases} else x.token end" if stemmed else "x.token"} as term from (
                                select doc_id, unnest(bare) as x, generate_subscripts(bare, 1) as place from (
                                    select doc_id, list_filter(list_transform(ws, lambda w, i: struct_pack(pos := i, token := w)), lambda x: x.token not in ({quoted(stop_tokens(stemmed))})) as bare
                                    from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN]+') as ws from {table}))))
                        where term in ({quoted(words_of(query))}) window o as (partition by doc_id order by place rows unbounded preceding))
                    window n as (partition by doc_id order by place))
                group by doc_id))
        where cover_rank > 0"""
