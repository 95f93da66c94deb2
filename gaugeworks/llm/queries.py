"""The queries of this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES, ORACLES = {}, {}
#: The modules of the queries; they need libraries that may be absent.
MODULES = [f"gaugeworks.llm.{name}" for name in ("bagminhash", "bpe", "linetext", "media", "mixing", "quality", "secret_scan", "substring", "vectors", "warc")] + ["public_tokenizers"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gaugeworks.llm.bpe import round_trip_digests

    out = round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


@_query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeworks.llm.substring import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op2_substring_dedup"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w as (select doc_id, i, array_to_string(words[i:i + 12], ' ') as run from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from d)),
f as (select run, min(doc_id) as first from w group by run),
g as (select distinct doc_id, unnest(range(i, i + 13)) as i from w join f using (run) where first < doc_id),
p as (select doc_id, words[i] as word, i from (select doc_id, words, unnest(range(1, len(words) + 1)) as i from d)),
k as (select doc_id, count(*) as n_kept, string_agg(word, ' ' order by i) as text from p anti join g using (doc_id, i) group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n_kept, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from d left join k using (doc_id)
"""


@_query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeworks.llm.mixing import plan

    return plan(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLES["op6_source_mixing"] = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         cast('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) as spot
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, row_number() over (order by source is null, encode(source)) - 1 as rank from s),
w as (select *, [5, 2, 1][cast(rank % 3 as int) + 1] as weight from r),
f as (
  select *, 2 * source_size as most, row_number() over (order by 2.0 * source_size / weight, rank) as place,
         1.5 * sum(source_size) over () - coalesce(sum(2 * source_size) over (order by 2.0 * source_size / weight, rank rows between unbounded preceding and 1 preceding), 0) as rest_words,
         sum(weight) over (order by 2.0 * source_size / weight, rank rows between current row and unbounded following) as rest_weight
  from w),
l as (select min(place) as first, arg_min(rest_words / rest_weight, place) as level from f where most > rest_words * weight / rest_weight),
t as (select source, rank, source_size, cast(case when place >= first then level * weight else most end as double) as target,
             greatest(1, least(4096, (source_size + 49999) // 50000)) as blocks from f, l),
g as (select *, cast(round_even(target, 0) as bigint) as goal from t),
b as (select d.*, g.rank, g.source_size, g.target, g.goal, cast(floor(d.spot / 4503599627370496.0 * g.blocks) as bigint) as block
      from d join g on d.source is not distinct from g.source),
k as (select rank, block, sum(size) as words from b group by all),
e as (select rank, block, sum(words) over (partition by rank order by cast('0x' || substr(md5('0:' || rank || ':' || block), 1, 13) as bigint), block) - words as begins from k),
o as (
  select b.*, e.begins, coalesce(sum(size) over (partition by b.rank, b.block order by spot, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from b join e using (rank, block))
select doc_id, size, source_size, target,
       cast(case when source_size = 0 then 0 else (goal // source_size) * size + greatest(0, least(size, goal % source_size - begins - before)) end as bigint) as taken
from o
"""


@_query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeworks.llm.quality import fit, score

    documents = _table(spark, sf_dir, "documents")
    return score(documents, fit(documents, _table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


@_query
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeworks.llm.bagminhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "kept")


ORACLES["op9_minhash_dedup"] = r"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
t as (select min(doc_id) as id, words from d where len(words) > 0 group by words),
s as (select id, run, count(*) as n from (select id, array_to_string(words[i:i + 4], ' ') as run from (select id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from t)) group by all),
z as (select id, sum(n) as size from s group by id),
o as (select a.id as a, b.id as b, sum(least(a.n, b.n)) as both_ from s a join s b on a.run = b.run and a.id <> b.id group by all),
l as (select a, b from o join z x on x.id = a join z y on y.id = b where both_ >= 0.8 * (x.size + y.size - both_)),
r as (select id as a, id as b from t union select r.a, l.b from r join l on r.b = l.a),
c as (select a as id, min(b) as class_id from r group by a)
select d.doc_id, coalesce(c.class_id, d.doc_id) as class_id, d.doc_id = coalesce(c.class_id, d.doc_id) as kept from d left join t on t.words = d.words left join c on c.id = t.id
"""


@_query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeworks.llm.secret_scan import scan

    return scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeworks.llm.linetext import extract

    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@_query
def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeworks.llm.vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLES["op8_vector_dedup"] = """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from r group by a),
n as (select a as vec_id, count(*) as n_links from l group by a)
select v.vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c using (vec_id) left join n using (vec_id)
"""


@_query
def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeworks.llm.warc import read_archives, write_archives

    return read_archives(write_archives(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op3_warc_archives"] = """
with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, lower(sha1(coalesce(html, ''))) as payload_digest from pages),
m as (select payload_digest, max(page_id) as last from p group by payload_digest)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id < last then last end as refers_to
from p join m using (payload_digest)
"""


@_query
def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeworks.llm.media import interleaved_pages, media_features, resolve, sequences, store_media

    stored = store_media(_table(spark, sf_dir, "documents"))
    out = resolve(sequences(interleaved_pages(stored), "id", "page"), media_features(stored))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("digest").alias("media_sha256"), "feature", "position", "n_items", "caption")
