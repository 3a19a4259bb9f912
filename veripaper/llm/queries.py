"""Registered queries of this subpackage, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_conversations, with_quotations
from .conversation_repair import damaged, repair_conversations
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .language_id import labelled_samples, language_id
from .line_dedup import line_dedup
from .near_dedup import near_dedup
from .packing import packed
from .quality_classifier import quality_scores
from .sentencepiece_bpe import sentencepiece_encoded
from .shared import table
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_array_dedup
from .vector_search import top_k_search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


@query(
    "op1_exact_dedup",
    """
    with n as (select doc_id, coalesce(length(text), 0) as n_points,
                      regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as content
               from documents),
         g as (select doc_id, sha256(content) as text_sha256,
                      first_value(doc_id) over (partition by content order by n_points desc, doc_id) as keep_id,
                      count(*) over (partition by content) as group_size
               from n)
    select doc_id, keep_id, group_size, keep_id = doc_id as kept, text_sha256 from g
    """,
)
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_id(docs, labelled_samples(docs))


@query(
    "op3_substring_dedup",
    """
    with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
               from documents),
         p as (select doc_id, unnest(range(1, len(w) - 48)) as s from d),
         k as (select p.doc_id, p.s, md5(array_to_string(w[p.s : p.s + 49], ' ')) as h from p join d using (doc_id)),
         f as (select *, min(doc_id) over (partition by h) as first_doc from k),
         c as (select distinct doc_id, unnest(range(s, s + 50)) as i from f where first_doc < doc_id),
         u as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
         r as (select doc_id, array_to_string(list(word order by i), ' ') as kept, count(*) as n_kept
               from u anti join c using (doc_id, i) group by doc_id)
    select doc_id, len(w) as n_words, len(w) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
    from d left join r using (doc_id)
    """,
)
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op5_suffix_array_dedup",
    """
    with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
         p as (select doc_id, unnest(range(0, length(x) // 2 - 99)) as s, x from d),
         k as (select doc_id, s, md5(substring(x, (2 * s + 1)::bigint, 200)) as h from p),
         f as (select doc_id, s, row_number() over (partition by h order by doc_id, s) as nth from k),
         j as (select doc_id, s, lag(s) over (partition by doc_id order by s) as before from f where nth > 1),
         o as (select doc_id, s, sum(case when before is null or s > before + 100 then 1 else 0 end)
                      over (partition by doc_id order by s) as run from j),
         r as (select doc_id, run, min(s) as a, max(s) + 100 as b from o group by doc_id, run),
         g as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as c from r),
         t as (select doc_id, list(substring(x, (2 * c + 1)::bigint, (2 * (a - c))::bigint) order by a) as pieces,
                      sum(b - a) as n_removed, count(*) as n_spans, max(b) as tail
               from g join d using (doc_id) group by doc_id)
    select doc_id, length(x) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
           sha256(unhex(case when pieces is null then x
                        else array_to_string(pieces, '') || substring(x, (2 * tail + 1)::bigint) end)) as kept_sha256
    from d left join t using (doc_id)
    """,
)
def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_array_dedup(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256")
    )


@query(
    "op10_minhash_near_dedup",
    """
    with recursive w as (
        select doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
            lambda x: x <> '') as w from documents),
    p as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as i from w),
    s as (select distinct doc_id, md5(array_to_string(w[i : i + 4], ' ') || case when len(w) < 5 then ' ' else '' end) as h from p),
    n as (select doc_id, count(*) as n from s group by doc_id),
    x as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
    e as (select a, b from x join n u on u.doc_id = a join n v on v.doc_id = b where 100 * c >= 75 * (u.n + v.n - c)),
    l as (select a, b from e union all select b, a from e),
    r as (select doc_id as v, doc_id as c from documents union select l.b, r.c from r join l on l.a = r.v),
    m as (select v, min(c) as component_id from r group by v)
    select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept
    from documents d left join n using (doc_id) join m on m.v = d.doc_id
    """,
)
def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup(table(spark, folder, "documents"))


@query("op8_packing")
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_encoded(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False
    )


@query(
    "op6_line_dedup",
    """
    with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as raw from documents),
    l as (select doc_id, unnest(range(0, len(raw))) as n, unnest(raw) as original,
                 unnest(list_transform(raw, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) as t
          from d),
    c as (select t, min((doc_id, n)) as first, strlen(t) as size from l where t <> '' group by t),
    p as (select a.t as t, a.first as own, b.first as other from c a join c b
          on a.size >= 20 and b.size between greatest(20, a.size - 2) and a.size + 2 and a.t <> b.t and levenshtein(a.t, b.t) <= 2),
    near as (select own, min(other) as least, count(*) as links from p group by own),
    m as (select l.doc_id, l.n, l.original, l.t, c.first <> (l.doc_id, l.n) as copy,
                 case when c.first = (l.doc_id, l.n) then coalesce(links, 0) else 0 end as links,
                 c.first <> (l.doc_id, l.n) or coalesce(least < c.first, false) as gone
          from l left join c using (t) left join near on near.own = c.first)
    select doc_id, count(*) filter (t <> '') as n_lines, count(*) filter (t <> '' and copy) as n_copies,
           count(*) filter (t <> '' and gone) as n_removed, coalesce(sum(links) filter (t <> ''), 0)::bigint as n_links,
           sha256(coalesce(string_agg(original, chr(10) order by n) filter (t = '' or not gone), '')) as kept_sha256
    from m group by doc_id
    """,
)
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_copies", "n_removed", "n_links", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op4_topk_search",
    """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
               where vec_id is not null and embedding is not null
                 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
          from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
    select query_id, rank, vec_id, score from r where rank <= 10
    """,
)
def op4_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return top_k_search(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


@query(
    "op7_chat_formatting",
    r"""
    with recursive m as (
        select c.conv_id, c.turn, c.role,
               case when c.turn % 3 = 2 and b.conv_id is not null
                    then '> > ' || replace(coalesce(b.text, ''), chr(10), chr(10) || '> > ') || chr(10) else '' end
               || case when a.conv_id is not null
                       then '> ' || replace(coalesce(a.text, ''), chr(10), chr(10) || '> ') || chr(10) else '' end
               || coalesce(c.text, '') as text
        from conversations c left join conversations a on a.conv_id = c.conv_id and a.turn = c.turn - 1
                             left join conversations b on b.conv_id = c.conv_id and b.turn = c.turn - 2),
    r as (select conv_id, turn, unnest(range(0, len(string_split(text, chr(10))))) as line, unnest(string_split(text, chr(10))) as raw from m),
    l as (select conv_id, turn, line, len(regexp_replace(regexp_extract(raw, '^([ \t]*>)+'), '[^>]', '', 'g')) as level,
                 lower(trim(regexp_replace(regexp_replace(raw, '^([ \t]*>)+', ''), '[ \t\n\v\f\r]+', ' ', 'g'))) as body from r),
    s as (select *, (body = '' or coalesce(lag(level) over w, -1) <> level)::int as opens from l window w as (partition by conv_id, turn order by line)),
    n as (select *, sum(opens) over (partition by conv_id, turn order by line) as run from s),
    u as (select distinct conv_id, turn, level, body from (
              select conv_id, turn, level, string_agg(body, ' ' order by line) as body from n where body <> '' group by conv_id, turn, level, run
              union all select conv_id, turn, level, body from n where body <> '')),
    o as (select q.conv_id, q.turn, q.level, q.body, max(w.turn) as origin
          from u q left join u w on w.level = 0 and w.conv_id = q.conv_id and w.body = q.body and w.turn < q.turn
          where q.level > 0 group by all),
    k as (select conv_id, turn, level, origin, sum(length(body)) as size from o where origin is not null group by all),
    p as (select conv_id, turn, max_by(origin, (-level, size, origin)) as reply_to from k group by all),
    c as (select conv_id, turn, count(*) as n_quotes, count(origin) as n_linked from o group by all),
    t as (select m.conv_id, m.turn, m.turn as thread, 0 as depth from m left join p using (conv_id, turn) where reply_to is null
          union all select p.conv_id, p.turn, t.thread, t.depth + 1 from p join t on t.conv_id = p.conv_id and t.turn = p.reply_to)
    select m.conv_id, m.turn, m.role, p.reply_to, t.thread, t.depth::bigint as depth, coalesce(c.n_quotes, 0) as n_quotes,
           coalesce(c.n_linked, 0) as n_linked, trim(coalesce(d.text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as message
    from m join conversations d using (conv_id, turn) left join p using (conv_id, turn) left join c using (conv_id, turn)
         join t using (conv_id, turn)
    """,
)
def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return format_conversations(with_quotations(table(spark, folder, "conversations")))


@query(
    "op11_filter_audit",
    """
    with recursive t as (
        select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
               list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
    f as (select doc_id, part,
                 (len(w) < 100)::int
                 + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
                 + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::int
                 + 8 * regexp_matches(text, '[#$%&*|]')::int
                 + 16 * (coalesce(doc_id, 9223372036854775807)
                         > min(coalesce(doc_id, 9223372036854775807)) over (partition by text))::int as failed from t),
    l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
    c as (select part, failed, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
          from f left join l using (doc_id) group by part, failed),
    o as (select '' as filter_order, 0 as before, 0 as after, 0 as bit, 0 as step, '' as taken
          union all
          select filter_order || x.name, o.after, o.after + x.bit, x.bit, step + 1, taken || x.name
          from o join (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as x(name, bit) on o.after & x.bit = 0),
    s as (select p.filter_order, o.step, o.before, o.after, o.bit from o join o p on p.step = 5 and o.step > 0
          and p.filter_order[1 : o.step] = o.filter_order),
    r as (select part, filter_order, step, bit,
                 sum(case when failed & after = 0 then n else 0 end) as kept,
                 sum(case when failed & before = 0 and failed & bit <> 0 then n else 0 end) as removed,
                 sum(case when failed & before <> 0 and failed & bit <> 0 then n else 0 end) as redundant,
                 sum(case when failed = bit then n else 0 end) as unique_fails,
                 sum(case when failed & before = 0 and failed & bit <> 0 then good else 0 end) as good_lost,
                 sum(case when failed & before = 0 and failed & bit <> 0 then toxic else 0 end) as toxic_lost
          from c cross join s group by all)
    select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
           unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
           (sum(removed) over (partition by part, bit))::bigint as shapley
    from r
    """,
)
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op13_conversation_repair",
    r"""
    with recursive crc as (
        select list(list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) order by i) as t
        from range(256) as r(i)),
    k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                 coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
    h as (select k.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: unicode(x)::bigint)),
                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 as kind from k cross join crc),
    d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
                 case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                 unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy from h),
    n as (select *, left(role, 1) as initial, row_number() over (partition by conv_id order by turn nulls first,
                 sha256(length(role) || ':' || role || text), copy) as i from d),
    f as (select *, lag(initial) over (partition by conv_id order by i) as before,
                 case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
                      when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault from n),
    c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                 count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
                 count(*) filter (fault = 'truncated') as truncated,
                 count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n
          from f group by conv_id),
    -- States: 0 nothing written, 1 a system turn, 2 a user turn last, 3 an assistant turn last.
    g as (select * from (values (0, 0, 0, []), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []),
                                (0, 1, 2, ['user:']), (1, 1, 2, ['user:']), (3, 1, 2, ['user:']), (2, 1, 3, ['assistant:']),
                                (0, 2, 3, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:']), (3, 2, 3, ['user:', 'assistant:']),
                                (2, 2, 2, ['assistant:', 'user:'])) as v(state, k, behind, lines)),
    e as (select * from (values (0, 's', 1, null), (0, 'u', 2, 'user:'), (1, 'u', 2, 'user:'), (3, 'u', 2, 'user:'), (2, 'a', 3, 'assistant:'))
          as v(state, initial, behind, role)),
    m as (select f.*, g.state as came, g.k, g.behind as state, g.lines from f cross join g),
    s as (select conv_id, i, came, state as behind, 5 * k + 2 as cost, repeat('I', k) || 'D' as audit, lines from m
          union all
          select conv_id, i, came, e.behind, 5 * k + case when e.initial = m.initial then 0 else 1 end + case when fault = 'truncated' then 5 else 0 end,
                 repeat('I', k) || case when e.initial = m.initial then 'K' else 'R' end,
                 list_append(lines, case when e.initial = m.initial then m.role || ':' else e.role end || text)
          from m join e on e.state = m.state and (e.initial = m.initial or e.role is not null) where fault not in ('blank', 'duplicate')),
    w as (select conv_id, 0::bigint as i, 0 as state, {'cost': 0, 'audit': '', 'lines': []::varchar[]} as best
          from (select distinct conv_id from conversations)
          union all
          select w.conv_id, w.i + 1, s.behind,
                 min({'cost': w.best.cost + s.cost, 'audit': w.best.audit || s.audit, 'lines': list_concat(w.best.lines, s.lines)})
          from w join s on s.conv_id is not distinct from w.conv_id and s.i = w.i + 1 and s.came = w.state group by w.conv_id, w.i, s.behind),
    z as (select w.conv_id, min({'cost': w.best.cost + 5 * g.k, 'audit': w.best.audit || repeat('I', g.k),
                                 'lines': list_concat(w.best.lines, g.lines)}) as best
          from w left join c on c.conv_id is not distinct from w.conv_id join g on g.state = w.state and g.behind in (0, 3)
          where w.i = coalesce(c.n, 0) group by w.conv_id)
    select z.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
           coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.cost::bigint as cost, best.audit as audit,
           sha256(array_to_string(best.lines, chr(10))) as repaired_sha256
    from z left join c on c.conv_id is not distinct from z.conv_id
    """,
)
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, folder, "conversations")), times="times")


@query("op12_quality_classifier")
def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    fifth = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), fifth == 0)
