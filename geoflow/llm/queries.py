"""The operators' registered queries, with production parameters over whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.llm import decontam, langid, pieces, secrets, simhash, substrings, tokens, topk, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langid.train(docs, learn=fold(4) != 2)
    judged = langid.identify(docs.select("doc_id", "text"), filters)
    return judged.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a folder that outlasts the call keeps the counts for later ones; without the setting a call has a cache of its own
    kept = spark.conf.get("spark.geoflow.tokenCache", None)
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache_path=kept)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=fold(5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


#: The rules that the query's contract names.
URL_RULES = [
    urls.Rule("allow", "com"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language, op2_token_counts, op3_pieces, op4_decontamination, op5_toxicity, op6_top_k, op7_substrings, op8_simhash, op9_secrets, op10_url_filters, pipeline)
}

_RULES_SQL = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op6_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as integer)) as q from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: cast(z[1] as bigint) * z[2])) as bigint) as score
              from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
        from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20""",
    "op10_url_filters": f"""
        with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                     regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) as path from u),
        r(verdict, rhost, rpath) as (values {_RULES_SQL}),
        f as (select p.page_id, r.rhost || r.rpath as rule, r.verdict from p join r
              on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath)
              qualify row_number() over (partition by p.page_id order by length(r.rhost || r.rpath) desc, r.rhost || r.rpath) = 1),
        j(pattern) as (values {", ".join("('" + r.pattern + "')" for r in urls.JUNK)}),
        m as (select p.page_id, min(j.pattern) as pattern from p join j on regexp_matches(p.host || p.path, j.pattern) group by p.page_id)
        select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, case when m.pattern is not null then 'block' end, 'allow') as verdict, m.pattern
        from p left join f using (page_id) left join m using (page_id)""",
}
