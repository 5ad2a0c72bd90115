"""The registered queries of this subpackage: each applies one operator to its whole table and returns the full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.topk_digest(table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    return substring_dedup.substring_digest(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tool_calls

    return tool_calls.tool_call_digest(table(spark, sf_dir, "conversations"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.warc_digest(table(spark, sf_dir, "pages"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.minhash_digest(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    caps = packing.Capacities(tokens=1024, documents=1024, attention=1024 * 1024)
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), caps, ranks=(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.ngram_digest(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexical

    return lexical.ranked_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import centroids

    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_quality_rules that no label decides, for which there is SQL."""
    from . import quality

    rows = quality.with_statistics(table(spark, sf_dir, "documents"), keep=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in names], quality.base_failed().alias("base_failed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_tool_calls": op4_tool_calls,
    "op5_warc": op5_warc,
    "op6_html_text": op6_html_text,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_ngram_join": op11_ngram_join,
    "op12_ranked_search": op12_ranked_search,
    "op13_centroids": op13_centroids,
    "quality_statistics": quality_statistics,
}

#: The words of a text column, as a list.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: Base 32 of the hexadecimal text h of a SHA-1.
BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(h, 5 * (i // 4) + 1, 5) as int) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '')"""



def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and floor means, written out one after the other."""
    assigned = """a{i} as materialized (
            select vec_id, v, min(struct_pack(d := cast(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint), c := c)) as b
            from v, c{i} group by vec_id, v
        )"""
    moved = """s{i} as (select b.c as c, i, cast(sum(v[i]) as bigint) as s, count(*) as n from a{i}, unnest(range(1, 65)) as u(i) group by 1, 2),
        m{i} as (select c, list((s - ((s % n) + n) % n) // n order by i) as m from s{i} group by c),
        c{j} as materialized (select c, coalesce(m{i}.m, c{i}.m) as m from c{i} left join m{i} using (c))"""
    steps = [x for i in range(rounds) for x in (assigned.format(i=i), moved.format(i=i, j=i + 1))] + [assigned.format(i=rounds)]
    return f"""
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
            where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        c0 as materialized (select row_number() over (order by h) - 1 as c, v as m from (select v, sha256('2:' || vec_id) as h from v order by h limit {k})),
        {", ".join(steps)},
        t as (select b.c as c, cast(sum(b.d) as bigint) as of from a{rounds} group by 1)
        select vec_id, cast(b.c as int) as cluster, b.d as distance, t.of as cluster_inertia, cast((select sum(of) from t) as bigint) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
        from a{rounds} join t on t.c = b.c join c{rounds} on c{rounds}.c = b.c"""


ORACLE_SQL: dict[str, str] = {
    "op13_centroids": _centroid_sql(),
    "op11_ngram_join": f"""
        with recursive d as (select doc_id, coalesce({WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) as w from documents),
        s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) as s from d),
        e as (select doc_id, len(s) as n, unnest(s) as g from s),
        n as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common from e a join e b on a.g = b.g and a.doc_id < b.doc_id
              and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2),
        l as (select a, b from n where 100 * common >= 85 * (na + nb - common)), links as (select a, b from l union select b, a from l),
        reach as (select doc_id as a, doc_id as b from d union select r.a, links.b from reach r join links on links.a = r.b)
        select s.doc_id, cast(len(s) as bigint) as n_shingles, c.least as component_id from s join (select a, min(b) as least from reach group by 1) c on c.a = s.doc_id""",
    "op12_ranked_search": r"""
        with d as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
        b as (select distinct item_id, t from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark)),
        n as (select doc_id, count(*) as n from d group by 1), g as (select count(*) as docs, cast(sum(n) as bigint) as terms from n),
        p as (select doc_id, t, count(*) as tf from d where t in (select t from b) group by 1, 2),
        w as (select t, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from p, g group by 1),
        s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) as bigint) as score from b join w using (t) join p using (t) join n using (doc_id), g group by 1, 2)
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0
        qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10""",
    "op2_substring_dedup": f"""
        with d as (select doc_id, {WORDS.format("text")} as w from documents),
        g as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as g from d, unnest(range(1, len(w) - 48)) as u(i)),
        f as (select g, min(doc_id) as first from g group by 1),
        r as (select g.doc_id, unnest(range(i, i + 50)) as pos from g join f using (g) where first < g.doc_id),
        c as (select doc_id, list(distinct pos) as pos from r group by 1),
        k as (select d.doc_id, w, pos, case when pos is null then w else list_filter(w, lambda x, i: not list_contains(pos, i)) end as kept from d left join c using (doc_id))
        select doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, cast(coalesce(len(pos), 0) as bigint) as n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) as kept_sha256 from k""",
    "op5_warc": f"""
        with p as (select page_id, coalesce(html, '') as html from pages), m as (select page_id, html, max(page_id) over (partition by html) as most, sha1(html) as h from p)
        select page_id, cast(strlen(html) as bigint) as payload_bytes, {BASE32} as payload_digest, case when page_id = most then 'response' else 'revisit' end as record_type, case when page_id <> most then most end as refers_to from m""",
    "op8_minhash_dedup": f"""
        with recursive d as (select doc_id, coalesce({WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) as w from documents),
        s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from d),
        e as (select doc_id, len(s) as n, unnest(s) as g from s),
        n as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common from e a join e b on a.g = b.g and a.doc_id < b.doc_id
              and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
        l as (select a, b from n where 100 * common >= 80 * (na + nb - common)), links as (select a, b from l union select b, a from l),
        reach as (select doc_id as a, doc_id as b from d union select r.a, links.b from reach r join links on links.a = r.b)
        select s.doc_id, cast(len(s) as bigint) as n_shingles, c.least as component_id, s.doc_id = c.least as kept from s join (select a, min(b) as least from reach group by 1) c on c.a = s.doc_id""",
    "quality_statistics": f"""
        with d as (select doc_id, coalesce(text, '') as text, coalesce({WORDS.format("text")}, []) as w from documents),
        g as (select doc_id, i, md5(array_to_string(w[i : i + 7], ' ')) as g from d, unnest(range(1, len(w) - 6)) as u(i)),
        t as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
        r as (select doc_id, count(distinct pos) as n from (select doc_id, unnest(range(i, i + 8)) as pos from t) group by 1),
        l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
        k as (select doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
            len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from d join l using (doc_id) left join r using (doc_id))
        select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from k""",
    "op4_tool_calls": """
        with c as (
            select conv_id, cast(turn as varchar) as call_id, min_by(turn, (text is null, text)) as turn, min_by(text, (text is not null, text)) as text
            from conversations where role = 'user' and conv_id is not null and turn is not null group by 1, 2
        ), r as (
            select conv_id, cast(turn - 1 as varchar) as call_id, min_by(text, (text is not null, text)) as content
            from conversations where role = 'assistant' and conv_id is not null and turn is not null group by 1, 2
        )
        , i as (select conv_id, turn, turn - 2 * row_number() over (partition by conv_id, turn % 2 order by turn) as island from c)
        select c.conv_id, c.turn, c.call_id, cast(row_number() over (partition by i.conv_id, i.turn % 2, island order by i.turn) - 1 as int) as level,
               r.call_id is not null as linked, c.text is not null as valid,
               sha256('{"arguments":{"role":"user",' || coalesce('"text":' || cast(to_json(c.text) as varchar) || ',', '') || '"turn":' || c.turn
                      || '},"id":"' || c.call_id || '","name":"reply","result":' || coalesce(cast(to_json(r.content) as varchar), 'null') || '}') as json_sha256
        from c join i using (conv_id, turn) left join r on c.conv_id = r.conv_id and c.call_id = r.call_id""",
    "op1_exact_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
            where vec_id is not null and embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id as vec_id,
                   cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0
        )
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
        from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5""",
}
