"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from millrace.llm.bpe import op10_bpe
from millrace.llm.chat_format import op7_chat_format
from millrace.llm.exact_dedup import op5_exact_dedup
from millrace.llm.lexical_search import op12_lexical_search
from millrace.llm.merkle import op13_merkle_manifest
from millrace.llm.ngram_join import op8_ngram_join
from millrace.llm.packing import op2_best_fit_packing
from millrace.llm.pii import op11_pii
from millrace.llm.quality_rules import op4_quality_rules
from millrace.llm.secrets import op6_secret_scan
from millrace.llm.token_files import op1_token_files
from millrace.llm.toxicity import op3_toxicity
from millrace.llm.url_filter import op9_url_filter

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_chat_format": op7_chat_format,
    "op8_ngram_join": op8_ngram_join,
    "op9_url_filter": op9_url_filter,
    "op10_bpe": op10_bpe,
    "op11_pii": op11_pii,
    "op12_lexical_search": op12_lexical_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op7_chat_format": r"""
        with t as (select conv_id, coalesce(turn, -1) as turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations where conv_id is not null),
        l as (select conv_id, max(struct_pack(turn := turn, text := text)) filter (role = 'assistant') as last from t group by 1),
        k as (select a.conv_id, a.last.turn as last_turn, b.last.text as other from l a left join l b on b.conv_id = xor(a.conv_id, 1)),
        r as (
            select conv_id as pair_id, 'chosen' as side, turn, role, text from t
            union all select t.conv_id, 'rejected', turn, role, text from t join k using (conv_id) where last_turn is null or turn < last_turn
            union all select conv_id, 'rejected', last_turn, 'assistant', other from k where last_turn is not null and other is not null),
        e as (
            select pair_id, turn,
                   coalesce(list_sort(list(role || chr(1) || text) filter (side = 'chosen')), [])
                     = coalesce(list_sort(list(role || chr(1) || text) filter (side = 'rejected')), []) as same
            from r group by 1, 2),
        f as (select pair_id, min(turn) filter (not same) as first_different from e group by 1),
        m as (select r.*, first_different is null or turn < first_different as common from r join f using (pair_id)),
        s as (
            select pair_id, case when common then 'prompt' else side end as segment, turn, role,
                   '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) as rendered, not common and role = 'assistant' as train
            from m where not common or side = 'chosen')
        select pair_id, segment, turn, role, rendered, case when train then cast(length(role) + 5 as bigint) else 0 end as train_start,
               case when train then cast(length(rendered) as bigint) else 0 end as train_stop
        from s
    """,
    "op5_exact_dedup": r"""
        with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id is not distinct from min(doc_id) over w as kept, text_sha256
        from n window w as (partition by text_sha256)
    """,
    "op12_lexical_search": r"""
        with d as (select row_number() over () as uid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
        n as (select uid, doc_id, cast(len(words) as bigint) as n from d where len(words) > 0),
        size as (select count(*) as total, cast(sum(n) as bigint) as length from n),
        q as (
            select distinct qid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from (select row_number() over () as qid, item_id, text from benchmark)),
        p as (select uid, term, count(*) as tf from (select uid, unnest(words) as term from d) where term in (select term from q) group by all),
        w as (select term, cast(floor(1000 * ln((2 * total + 2)::double / (2 * df + 1)::double)) as bigint) as w from (select term, count(*) as df from p group by 1), size),
        s as (
            select qid, item_id, doc_id, uid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total) // length)))) as score
            from q join p using (term) join w using (term) join n using (uid), size group by all),
        r as (select item_id, cast(row_number() over (partition by qid order by score desc, doc_id nulls last) as integer) as rank, doc_id, score from s where score > 0)
        select item_id, rank, doc_id, cast(score as bigint) as score from r where rank <= 10
    """,
    "op13_merkle_manifest": r"""
        with recursive t as (
            select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crcs),
        f as (
            select doc_id, lang, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
                   coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as n, coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') as more, coalesce(strlen(text) || ':' || text, '-') as tail,
                   xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) as crc
            from documents, t),
        d as (select doc_id, lang, sha256(head || n || tail) as leaf, case when crc % 7 = 0 then sha256(head || more || tail) else sha256(head || n || tail) end as shown from f),
        g as (select lang, row_number() over (order by lang nulls first) - 1 as gid, count(*) as size from documents group by lang),
        l as (select d.*, gid, size, row_number() over (partition by d.lang order by doc_id nulls first, leaf) - 1 as idx from d join g on d.lang is not distinct from g.lang),
        n as (
            select gid, 0 as level, idx, size, leaf as digest from l
            union all
            select gid, level + 1, idx // 2, size, sha256(string_agg(digest, '' order by idx)) from n where size > (1 << level) group by gid, level, idx // 2, size),
        s as (select gid, size, arg_max(digest, level) as subroot from n group by 1, 2),
        m as (
            select 0 as level, gid as idx, (select count(*) from g) as size, subroot as digest from s
            union all
            select level + 1, idx // 2, size, sha256(string_agg(digest, '' order by idx)) from m where size > (1 << level) group by level, idx // 2, size),
        r as (select arg_max(digest, level) as root from m),
        p as (
            select l.gid, l.idx, k.level, (l.idx >> k.level) % 2 as odd, b.digest as beside
            from l join (select distinct gid, level from n) k on k.gid = l.gid and l.size > (1 << k.level) left join n b on b.gid = l.gid and b.level = k.level and b.idx = xor(l.idx >> k.level, 1)
            union all
            select l.gid, l.idx, 64 + k.level, (l.gid >> k.level) % 2, b.digest
            from l join (select distinct level, size from m) k on k.size > (1 << k.level) left join m b on b.level = k.level and b.idx = xor(l.gid >> k.level, 1)),
        o as (select *, row_number() over (partition by gid, idx order by level) as step from p),
        w as (
            select gid, idx, 0 as step, shown as digest from l
            union all
            select w.gid, w.idx, o.step, sha256(case when beside is null then digest when odd = 1 then beside || digest else digest || beside end) from w join o on o.gid = w.gid and o.idx = w.idx and o.step = w.step + 1),
        z as (select gid, idx, arg_max(digest, step) as folded_root from w group by 1, 2),
        q as (select gid, idx, sha256(coalesce(string_agg(beside, '' order by step), '')) as proof_sha256 from o group by 1, 2)
        select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
        from l join s using (gid) join z using (gid, idx) left join q using (gid, idx), r
    """,
}
