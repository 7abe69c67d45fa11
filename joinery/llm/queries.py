"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, lexicon, media, minhash, packing, quality, token_counts, token_files, warc
from .common import Workspace

END_OF_TEXT = 50256


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), 1024, 0, with_ids=False)


def op3_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encode(table(spark, sf_dir, "documents"), tokenizer(), with_ids=False)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"), tokenizer(), END_OF_TEXT)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_warc(table(spark, sf_dir, "pages"), Workspace(spark, "warc"))
    return warc.read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"), with_payload=False)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer(), 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_nearest_vectors, op2_packing, op3_bpe_lexicon, op4_token_counts, op5_warc, op6_near_duplicates, op7_quality, op8_language, op9_media, op10_token_files)
}

ORACLE_SQL: dict[str, str] = {
    "op1_nearest_vectors": """
        with v as (
            select vec_id, cast(embedding as double[]) as e from embeddings
            where embedding is not null and vec_id is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        d as (
            select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
        r as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from d)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10""",
    "op5_warc": """
        with p as (
            select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n,
                   sha1(coalesce(html, '')) as digest
            from pages),
        g as (select digest, max(page_id) as response from p where n >= 1000 group by digest having count(*) > 1)
        select p.page_id, cast(p.n as bigint) as payload_bytes, p.digest as payload_digest,
               case when g.response is not null and g.response is distinct from p.page_id then 'revisit' else 'response' end as record_type,
               case when g.response is distinct from p.page_id then g.response end as refers_to
        from p left join g on p.digest = g.digest""",
    "op6_near_duplicates": r"""
        with recursive w as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
            from documents),
        s as (
            select doc_id, unnest(list_distinct(case
                when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end)) as shingle
            from w),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
        l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 75 * (x.n + y.n - c)),
        e as (select a, b from l union all select b, a from l),
        reach as (select doc_id, doc_id as other from documents union select reach.doc_id, e.b from reach join e on reach.other = e.a),
        c as (select doc_id, min(other) as component_id from reach group by doc_id)
        select c.doc_id, coalesce(n.n, 0) as n_shingles, component_id, c.doc_id = component_id as kept from c left join n on n.doc_id = c.doc_id""",
}
