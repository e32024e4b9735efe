"""The registered queries opN_<name> and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank.llm import clusters, fingerprint, jaccard, lm, negatives, packing, quality, repeats, sharding, spans, spm, token_counts, url_filter
from driftrank.tables import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digests(table(spark, sf_dir, "documents"), PIECES)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*url_filter.HOST_RULES, *url_filter.PATTERNS]
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "longest_shared", "shared_words")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.dedup(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", F.col("__before").alias("n_chars"), F.col("__sentences").alias("n_sentences"), F.col("__removed").alias("n_removed"),
        F.char_length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTES)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.kd_tree(table(spark, sf_dir, "documents"), leaves=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), WORDS)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(noisy, F.col("vec_id") % 100 == 0)


ALL = (
    op1_sentencepiece, op2_url_filter, op3_quality_rules, op4_ngram_jaccard, op5_lm_scoring, op6_suffix_dedup, op7_fingerprint, op8_substring_dedup, op9_packing, op10_sharding,
    op11_token_counts, op12_clusters, op13_hard_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _url_sql(), "op12_clusters": _cluster_sql(), "op13_hard_negatives": _negatives_sql()}


def _cluster_sql(k: int = 16, rounds: int = 3, factor: int = 64, width: int = 64) -> str:
    steps = [f"""
kept as (select row_number() over (order by vec_id, embedding) as row, vec_id, list_transform(embedding, lambda x: cast(floor({factor} * cast(x as double)) as hugeint)) as v
         from embeddings where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is not null and isfinite(x) and abs(cast(x as double)) < {(1 << 27) / factor})) = {width}),
parts as (select row, unnest(v) as x, unnest(range({width})) as d from kept),
c0 as (select place, unnest(v) as y, unnest(range({width})) as d from (select v, row_number() over (order by sha256('1:' || vec_id), v) - 1 as place from kept) where place < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
d{i} as (select p.row, c.place, sum((p.x - c.y) * (p.x - c.y)) as far from parts p join c{i} c on p.d = c.d group by all),
a{i} as (select row, arg_min(place, (far, place)) as place, min(far) as far from d{i} group by row)""")
        if i < rounds:
            steps.append(f"""
m{i} as (select a.place, p.d, sum(p.x) as s, count(*) as n from parts p join a{i} a on p.row = a.row group by all),
c{i + 1} as (select c.place, c.d, case when n is null then c.y else (s - ((s % n) + n) % n) // n end as y from c{i} c left join m{i} m on c.place = m.place and c.d = m.d)""")
    return f"""with {",".join(steps)},
h as (select place, sha256(string_agg(cast(y as varchar), ',' order by d)) as centroid_sha256 from c{rounds} group by place)
select k.vec_id, cast(a.place as int) as cluster, cast(a.far as bigint) as distance, cast(sum(a.far) over (partition by a.place) as bigint) as cluster_inertia,
       cast(sum(a.far) over () as bigint) as inertia, h.centroid_sha256
from kept k join a{rounds} a on k.row = a.row join h on h.place = a.place"""


def _negatives_sql(positives: int = 5, negatives_: int = 10, low: int = 30, high: int = 90, factor: int = 256) -> str:
    return f"""
with kept as (select row_number() over () as row, vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
                     list_transform(embedding, lambda x: floor({factor} * cast(x as double))) as v
              from embeddings where label is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is not null and isfinite(x) and abs(cast(x as double)) < {(1 << 27) / factor})) = len(embedding)),
scored as (select a.row as anchor, a.vec_id as anchor_id, r.row, r.vec_id, a.label = r.label as same, cast(list_inner_product(a.v, r.v) as bigint) as score
           from kept a join kept r on a.vec_id % 100 = 0 where a.row <> r.row),
pos as (select * from (select *, row_number() over (partition by anchor order by score desc, vec_id) as place from scored where same) where place <= {positives}),
neg as (select p.anchor, p.anchor_id, p.place, p.vec_id as positive_id, p.score as positive_score, n.vec_id as negative_id, n.score as negative_score,
               row_number() over (partition by p.anchor, p.place order by n.score desc, n.vec_id) as rank
        from pos p join scored n on p.anchor = n.anchor and not n.same and 100 * n.score between {low} * p.score and {high} * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from neg where rank <= {negatives_}"""


def _url_sql() -> str:
    rules = ", ".join(f"('{r.name}', '{r.verdict}', '{r.regex}', {r.length}, '{r.kind}')" for r in [*url_filter.HOST_RULES, *url_filter.PATTERNS])
    part = r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(.*)$', {}), '')"
    return f"""
with rules(name, verdict, regex, length, kind) as (values {rules}),
u as (select page_id, url, translate({part.format(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, {part.format(2)} as path, {part.format(3)} as rest from pages),
d as (select distinct url, host, path, rest from u where contains(url, '://')),
h as (select d.url, r.*, row_number() over (partition by d.url order by case when kind = 'host' then 0 else 1 end, case when kind = 'pattern' and verdict = 'block' then 1 else 0 end, length desc, name) as place
      from d join rules r on regexp_matches(case when r.kind = 'host' then host || path || rest else lower(host || path || rest) end, r.regex))
select u.page_id, u.host, u.path, case when h.kind = 'host' then h.name end as rule, coalesce(h.verdict, 'allow') as verdict, case when h.kind = 'pattern' then h.name end as pattern
from u left join h on u.url = h.url and h.place = 1"""
