"""The registered queries of this subpackage and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding_dedup import near_vectors
from .exact_dedup import against_new_index
from .impact_search import search as inner_products
from .jaccard_join import near_texts
from .language_id import identify
from .mixing import mix_plan
from .packing import pack
from .quotations import formatted
from .repeats import remove_repeats
from .token_files import round_trip
from .toxicity import score
from .treap_search import search as ranked
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("ranges")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_new_index(spark, table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.withColumn("position", F.round(F.get("takes", F.lit(0))["position"], 9)).drop("source", "takes")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_products(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_chat_formatting,
        op3_toxicity,
        op4_exact_dedup,
        op5_ngram_jaccard_join,
        op6_embedding_near_dedup,
        op7_token_ids,
        op8_mixing,
        op9_packing,
        op10_language_id,
        op11_ranked_search,
        op12_embedding_whitening,
        op13_exact_top_k,
    )
}

ORACLES = {
    "op2_chat_formatting": r"""
        with recursive m as (
            select {'known': conv_id is not null, 'id': coalesce(conv_id, 0)::bigint} as conv_id, {'known': turn is not null, 'id': coalesce(turn, 0)::bigint} as turn,
                   role, text, row_number() over (partition by conv_id, turn order by role nulls first, text nulls first)::int - 1 as copy
            from conversations),
        l as (
            select conv_id, turn, copy, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as n, unnest(string_split(coalesce(text, ''), chr(10))) as line from m),
        v as (
            select conv_id, turn, copy, n, len(regexp_extract(line, '^([ \t]*>)+')) - len(replace(regexp_extract(line, '^([ \t]*>)+'), '>', '')) as level,
                   regexp_replace(line, '^([ \t]*>)+ ?', '') as line from l),
        s as (select *, case when level <> lag(level, 1, -1) over (partition by conv_id, turn, copy order by n) then 1 else 0 end as new from v),
        g as (select *, sum(new) over (partition by conv_id, turn, copy order by n) as passage from s),
        r as (select conv_id, turn, copy, passage, min(level) as level, string_agg(line, chr(10) order by n) as text from g group by all),
        b as (select conv_id, turn, copy, string_agg(text, chr(10) order by passage) as body from r where level = 0 group by all),
        w as (
            select conv_id, turn, text as t from r where level = 0
            union all select conv_id, turn, line from g where level = 0
            union all select conv_id, turn, body from b),
        f as (select conv_id, trim(regexp_replace(lower(t), '[ \t\r\n]+', ' ', 'g')) as norm, min(turn) as origin from w group by all),
        c as (select conv_id, turn, copy, passage, level, n, trim(regexp_replace(lower(line), '[ \t\r\n]+', ' ', 'g')) as norm from g),
        y as (select conv_id, turn, copy, chr(10) || string_agg(norm, chr(10) order by n) || chr(10) as lines from c where level = 0 and norm <> '' group by all),
        z as (
            select conv_id, turn, copy, passage, chr(10) || string_agg(norm, chr(10) order by n) || chr(10) as lines
            from c where level > 0 and norm <> '' group by all having count(*) > 1),
        x as (
            select z.conv_id, z.turn, z.copy, z.passage, min(y.turn) as origin
            from z join y on y.conv_id = z.conv_id and contains(y.lines, z.lines) group by all),
        q as (
            select r.conv_id, r.turn, r.copy, r.passage, r.level, case when f.origin < r.turn then f.origin when x.origin < r.turn then x.origin end as origin
            from (select *, trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) as norm from r where level > 0) r
            left join f on f.conv_id = r.conv_id and f.norm = r.norm
            left join x on x.conv_id = r.conv_id and x.turn = r.turn and x.copy = r.copy and x.passage = r.passage where r.norm <> ''),
        k as (
            select conv_id, turn, copy, count(*) as n_quotes, count(origin) as n_linked,
                   arg_min(origin, level * 1000000000 + passage) filter (origin is not null) as origin
            from q group by all),
        t as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as before from (select distinct conv_id, turn from m)),
        j as (
            select m.conv_id, m.turn, m.copy, m.role, coalesce(k.origin, t.before) as answers_turn,
                   coalesce(k.n_quotes, 0) as n_quotes, coalesce(k.n_linked, 0) as n_linked,
                   regexp_replace(coalesce(b.body, ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') as text
            from m join t on t.conv_id = m.conv_id and t.turn = m.turn
            left join k on k.conv_id = m.conv_id and k.turn = m.turn and k.copy = m.copy
            left join b on b.conv_id = m.conv_id and b.turn = m.turn and b.copy = m.copy),
        u as (select conv_id, turn, min(answers_turn) as up from j group by all),
        d as (
            select conv_id, turn, 0::bigint as depth from u where up is null
            union all select u.conv_id, u.turn, d.depth + 1 from d join u on u.conv_id = d.conv_id and u.up = d.turn)
        select case when j.conv_id.known then j.conv_id.id end as conv_id, case when j.turn.known then j.turn.id end as turn, j.copy, j.role,
               case when j.answers_turn.known then j.answers_turn.id end as answers_turn, j.n_quotes, j.n_linked, j.text, d.depth, '<|' || coalesce(j.role, 'unknown') || '|>' || chr(10) || j.text || chr(10) as formatted
        from j join d on d.conv_id = j.conv_id and d.turn = j.turn""",
    "op4_exact_dedup": """
        with d as (
            select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
            from documents),
        g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, d.text_sha256
        from d join g using (text_sha256)""",
    "op8_mixing": r"""
        with d as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
        s as (
            select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
        w as (select *, case rank % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end::double as weight, 2.0::double * source_size as cap from s),
        o as (
            select *, row_number() over f as ord,
                   ((select sum(source_size) from s)::double * 1.5 - coalesce(sum(cap) over (f rows between unbounded preceding and 1 preceding), 0))
                   / sum(weight) over (f rows between current row and unbounded following) as level
            from w window f as (order by cap / weight, rank)),
        x as (select min_by(level, ord) as level from o where level * weight <= cap),
        t as (
            select o.source, o.rank, o.source_size, case when x.level is null then o.cap else least(o.cap, x.level * o.weight) end as target
            from o, x),
        p as (
            select d.doc_id, d.size, t.source_size, t.target, t.rank,
                   coalesce(sum(d.size) over (partition by t.rank order by md5(coalesce(d.doc_id::varchar, 'null')), d.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before
            from d join t on t.source is not distinct from d.source),
        k as (
            select *, greatest(0, least(size, floor(target + 0.5)::bigint - before)) as first,
                   greatest(0, least(size, floor(target + 0.5)::bigint - before - source_size)) as second,
                   before / target as u, case rank % 3 when 0 then 0.5 when 1 then 0.0 else -0.5 end::double as a
            from p)
        select doc_id, size, source_size, target, (first + second)::bigint as taken,
               case when first > 0 then round(case when a = 0 then u else (sqrt((1.0::double - a) * (1.0::double - a) + 4.0::double * a * u) - (1.0::double - a)) / (2.0::double * a) end, 9) end as position
        from k""",
    "op11_ranked_search": r"""
        with words as (
            select 'd' as kind, row_number() over () as r, doc_id as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
            union all
            select 'i', row_number() over (), item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') from benchmark),
        s as (select count(*)::bigint as n_docs, sum(len(terms))::bigint as n_terms from words where kind = 'd' and len(terms) > 0),
        i as (select distinct r, id, term from (select r, id, unnest(terms) as term from words where kind = 'i')),
        p as (
            select r, id, n, term, count(*) as tf from (select r, id, len(terms) as n, unnest(terms) as term from words where kind = 'd')
            where term in (select term from i) group by all),
        w as (select term, floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * count(*) + 1)))::bigint as w from p, s group by term, n_docs),
        c as (
            select i.r as item, i.id as item_id, p.r as doc, p.id as doc_id,
                   sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::bigint as score
            from i join p using (term) join w using (term), s group by all),
        o as (select *, row_number() over (partition by item order by score desc, doc_id, doc) as rank from c where score > 0)
        select item_id, rank::int as rank, doc_id, score from o where rank <= 10""",
    "op13_exact_top_k": """
        with v as (
            select vec_id, row_number() over () as r, list_transform(embedding, lambda e: floor(256 * e::double)) as x from embeddings
            where vec_id is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda e: e is not null and isfinite(e)))),
        s as (
            select q.vec_id as query_id, q.r as q, c.vec_id, c.r, list_dot_product(q.x, c.x)::bigint as score
            from v q join v c on q.r <> c.r and len(q.x) = len(c.x) where q.vec_id % 50 = 0),
        o as (select *, row_number() over (partition by q order by score desc, vec_id) as rank from s)
        select query_id, rank::int as rank, vec_id, score from o where rank <= 5""",
}
