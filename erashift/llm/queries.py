"""The registered queries of the text operators, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erashift import session
from erashift.llm import (
    decontaminate, exact_dedup, hard_negatives, licenses, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, suffix_dedup,
    toxicity, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ASCII_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(key: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.configure(spark)
            return fn(spark, sf_dir)

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return wrap


@query("op5_exact_dedup", f"""
with d as (select doc_id, sha256(translate(coalesce(text, ''), {ASCII_LOWER})) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
""")
def op5(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op6_sharding")
def op6(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 16)


@query("op9_mixing", f"""
with d as (select doc_id, source, len({WORDS})::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, 2.0::double * source_size as cap,
             ([3.0, 1.0, 2.0]::double[])[1 + (row_number() over (order by source nulls last) - 1) % 3] as w,
             row_number() over (order by source nulls last) as n from s),
l as (select *, cap / w as r,
             (1.5::double * sum(source_size) over () - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
      from w window b as (order by cap / w, n rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, case when r <= level then cap else w * max(case when r > level then level end) over () end as target from l),
q as (select d.doc_id, d.size, t.source_size, t.target,
             sum(d.size) over (partition by d.source order by md5(d.doc_id::varchar), d.doc_id)::bigint as queued
      from d join t on d.source is not distinct from t.source),
c as (select doc_id, size, (copy * source_size + queued) / target as finish from q, (values (0), (1)) v(copy) where target > 0),
u as (select finish, sum(size) over (order by finish) as upto from c),
f as (select max(finish) as last from u where upto <= (select sum(target) from t))
select q.doc_id, q.size, q.source_size, round(q.target, 4) as target,
       case when target > 0 then q.size * ((queued / target <= last)::bigint + ((source_size + queued) / target <= last)::bigint) else 0 end as taken
from q, f
""")
def op9(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


@query("op10_line_dedup", f"""
with l as (select doc_id, pos, line,
                  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {ASCII_LOWER}) as key
           from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
k as (select key, min(doc_id) as first from l where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select l.*, k.key is not null and l.doc_id > k.first as dropped from l left join k using (key))
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from m group by doc_id
""")
def op10(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


@query("op4_toxicity")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, table(spark, sf_dir, "labels")))


@query("op7_quality")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


@query("op3_decontamination", r"""
with i as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from benchmark),
d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents),
s as (select distinct item_id, array_to_string(w[p : p + 4], ' ') as shingle
      from (select item_id, w, unnest(range(1, len(w) - 3)) as p from i)),
n as (select item_id, count(*) as n_item from s group by item_id),
t as (select distinct doc_id, array_to_string(w[p : p + 4], ' ') as shingle
      from (select doc_id, w, unnest(range(1, len(w) - 3)) as p from d)),
m as (select doc_id, item_id, count(*) as n_shared from t join s using (shingle) group by doc_id, item_id)
select doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) as containment
from m join n using (item_id) where n_shared * 100 >= n_item * 80
""")
def op3(spark, sf_dir):
    found = decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round("containment", 6))


@query("op1_near_dedup", f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {ASCII_LOWER}), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[p : p + 2], ' ') as shingle
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
b as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by 1, 2),
e as materialized (select a, b from b join n p on p.doc_id = a join n q on q.doc_id = b.b where 100 * shared >= 85 * (p.n + q.n - shared)),
r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.b) as component_id, d.doc_id = min(r.b) as kept
from d left join n using (doc_id) join r on r.a = d.doc_id group by d.doc_id, n.n
""")
def op1(spark, sf_dir):
    return near_dedup.near_components(table(spark, sf_dir, "documents"), k=3, threshold_pct=85)


@query("op2_substring_dedup", r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
t as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d),
h as (select doc_id, p, w[p] as word, case when p + 49 <= len(w) then md5(array_to_string(w[p : p + 49], ' ')) end as h from t),
f as (select h, min(doc_id) as first from h where h is not null group by h),
c as (select doc_id, p, word, max(case when first < doc_id then 1 else 0 end)
             over (partition by doc_id order by p rows between 49 preceding and current row) as gone from h left join f using (h))
select d.doc_id, count(c.p) as n_words, coalesce(sum(c.gone), 0)::bigint as n_removed,
       sha256(coalesce(string_agg(c.word, ' ' order by c.p) filter (c.gone = 0), '')) as kept_sha256
from d left join c using (doc_id) group by d.doc_id
""")
def op2(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


@query("op8_suffix_dedup", r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
t as (select doc_id, x, unnest(range(0, length(x) // 2)) as p from d),
h as (select doc_id, p, substr(x, 2 * p + 1, 2) as b, case when 2 * (p + 100) <= length(x) then md5(substr(x, 2 * p + 1, 200)) end as h from t),
f as (select doc_id, p, b, h is not null and row_number() over (partition by h order by doc_id, p) > 1 as again from h),
c as (select doc_id, p, b, max(case when again then 1 else 0 end)
             over (partition by doc_id order by p rows between 99 preceding and current row) as gone from f),
s as (select *, gone = 1 and coalesce(lag(gone) over (partition by doc_id order by p), 0) = 0 as begins from c)
select d.doc_id, count(s.p) as n_bytes, coalesce(sum(s.gone), 0)::bigint as n_removed, count(*) filter (s.begins) as n_spans,
       sha256(unhex(coalesce(string_agg(s.b, '' order by s.p) filter (s.gone = 0), ''))) as kept_sha256
from d left join s using (doc_id) group by d.doc_id
""")
def op8(spark, sf_dir):
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept_bytes")


@query("op11_license_scan", licenses.oracle_sql())
def op11(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


@query("op12_whitening")
def op12(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_hard_negatives", """
with u as (select vec_id, label, embedding from embeddings where vec_id is not null and label is not null and embedding is not null
           and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
r as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                          list_transform(embedding, lambda c: floor(256 * c::double)) as x from u),
s as materialized (select a.vec_id as anchor_id, a.label = r.label as same, r.vec_id, list_inner_product(a.x, r.x)::bigint as score
                   from r a join r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over w as rank, s.vec_id as negative_id, positive_score, s.score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * s.score and s.score <= positive_score
window w as (partition by anchor_id, positive_id order by s.score desc, s.vec_id) qualify row_number() over w <= 5
""")
def op13(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    shifted = F.when(vectors["vec_id"] % 7 == 0, (vectors["label"] + 1) % 10).otherwise(vectors["label"])
    return hard_negatives.mine_hard_negatives(vectors, vectors["vec_id"] % 100 == 0, shifted)
