"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatescan.llm import bpe, curriculum, jaccard, language, mixing, packing, quality, retrieval, secrets, substrings, urls, vectors, whitening
from gatescan.operators.scans import number_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The tokenizer file, installed at the same place on every machine; GATESCAN_VOCABULARY names another."""
    return os.environ.get("GATESCAN_VOCABULARY") or public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(_table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), of("entropy"))


#: The url rules of op8: (host, path prefix).
ALLOW_RULES = [("com", "/"), ("www.example.com", "/en/")]
BLOCK_RULES = [("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), ALLOW_RULES, BLOCK_RULES)


OP8_SQL = """
with p as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), q as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p
), r(rhost, rpath, verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m as (
  select page_id, max_by(rhost || rpath, length(rhost || rpath)) as rule, max_by(verdict, length(rhost || rpath)) as verdict
  from q join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id
)
select q.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') as verdict from q left join m using (page_id)
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l,
    len(regexp_extract_all(coalesce(text, ''), '(?:\.\.\.|\x{2026})[ \t]*(?:\n|$)')) as n_ellipses, len(regexp_extract_all(coalesce(text, ''), '(?:^|\n)[ \t]*[-*\x{2022}][ \t]')) as n_bullets,
    len(regexp_extract_all(coalesce(text, ''), '[0-9]')) as n_digits from documents
), g as (
  select doc_id, i, list_slice(w, i, i + 7) as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)
), t as (
  select doc_id, i, count(*) over (partition by doc_id, g) as c from g
), r as (
  select doc_id, count(distinct i + k) as n from t, range(8) as o(k) where c > 1 group by doc_id
), s as (
  select d.doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines, n_ellipses, n_bullets, n_digits,
    coalesce(r.n, 0) as n_repeat_words from d left join r using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 10 * n_symbols > word_chars or (n_lines > 3 and 100 * n_dup_lines > 50 * n_lines)
    or word_chars < 2 * n_words or word_chars > 20 * n_words or (n_lines > 3 and (100 * n_ellipses > 30 * n_lines or 100 * n_bullets > 90 * n_lines))
    or 100 * n_digits > 50 * word_chars) as kept
from s
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()))
    found = language.predict(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(_table(spark, sf_dir, "documents"))


#: The schedules of op12 by the place of a source: level, rising and falling; their areas, the sources' weights, are 1, 2 and 3.
SCHEDULES = ((1.0, 1.0), (1.0, 3.0), (4.5, 1.5))


def op12_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    numbered = number_rows(docs.select("source").distinct(), [F.col("source").asc_nulls_last()])
    knots = F.array(*[F.array(*[F.struct(F.lit(float(at)).alias("at"), F.lit(w).alias("weight")) for at, w in enumerate(s)]) for s in SCHEDULES])
    schedule = numbered.select("source", F.inline(F.get(knots, ((F.col("row_number") - 1) % len(SCHEDULES)).cast("int"))))
    return curriculum.curriculum(docs, schedule).select("doc_id", "size", "source_size", "target", "taken", "position")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
with d as (select doc_id, row_number() over () as r, {_TERMS} as w from documents),
b as (select item_id, row_number() over () as i, {_TERMS} as w from benchmark),
k as (select cast(count(*) as bigint) as nn, cast(sum(len(w)) as bigint) as ll from d where len(w) > 0),
q as (select i, term, count(*) as q from (select i, unnest(w) as term from b) group by all),
t as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by all),
f as (select term, cast(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) as bigint) as wt from t, k group by term, nn),
m as (select r, doc_id, 75 + (25 * len(w) * nn) // ll as m from d, k where len(w) > 0),
s as (select i, r, cast(sum(q * wt * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score from q join t using (term) join f using (term) join m using (r) group by i, r),
o as (select i, doc_id, score, row_number() over (partition by i order by score desc, doc_id) as rank from s join m using (r) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from o join b using (i) where rank <= 20
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


OP12_SQL = r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as h from documents
), s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, (row_number() over (order by source nulls last) - 1) % 3 as kind from s),
f(rest, weights) as (
  select cast(sum(source_size) as double), cast(sum(kind + 1) as double) from r
  union all
  select total - capped, remaining from f, lateral (
    select cast(sum(source_size) as double) as total, coalesce(sum(case when f.rest * (kind + 1) / f.weights > 3.0 * source_size then 3.0 * source_size end), 0)::double as capped,
      sum(case when f.rest * (kind + 1) / f.weights <= 3.0 * source_size then kind + 1 end)::double as remaining from r) x
  where remaining < f.weights
), t as (select r.*, least(3.0::double * source_size, z.rest * (kind + 1) / z.weights) as target, kind + 1.0::double as area,
  case kind when 0 then 1.0 when 1 then 1.0 else 4.5 end::double as w, case kind when 0 then 0.0 when 1 then 2.0 else -3.0 end::double as slope
  from r, (select min_by(rest, weights) as rest, min(weights) as weights from f) z),
p as (select d.*, source_size, target, area, w, slope, coalesce(sum(size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as begun,
  cast(floor(target) as bigint) // greatest(source_size, 1) as full_passes, cast(floor(target) as bigint) - (cast(floor(target) as bigint) // greatest(source_size, 1)) * source_size as remainder
  from d join t on d.source is not distinct from t.source),
k as (select *, full_passes * size + greatest(0, least(size, remainder - begun)) as taken, begun * area / target as x from p)
select doc_id, size, source_size, target, cast(taken as bigint) as taken, case when taken > 0 then case when x > 0 then 2 * x / (w + sqrt(w * w + 2 * slope * x)) else 0.0 end end as position from k
"""


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: Components of a table l(a, b) of links in both directions, over documents or vectors n(id).
_REACH = """
reach(id, low) as (select id, id from n union select l.b, r.low from reach r join l on l.a = r.id where r.low < l.b),
c as (select id, min(low) as component_id from reach group by id)"""

OP3_SQL = f"""
with recursive v as (
  select vec_id as id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null
), n as (select vec_id as id from embeddings), l as (
  select x.id as a, y.id as b from v x join v y on x.label = y.label and x.id <> y.id and len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.93
), {_REACH}
select id as vec_id, (select count(*) from l where a = c.id) as n_links, component_id, id = component_id as kept from c
"""

OP5_SQL = f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
g as (select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
m as (select g, min(doc_id) as least from g group by g),
r as (select distinct g.doc_id, g.i + k as p from g join m using (g), range(13) o(k) where m.least < g.doc_id),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
k as (select x.doc_id, count(r.p) as n, string_agg(word, ' ' order by x.p) filter (where r.p is null) as kept from x left join r on r.doc_id = x.doc_id and r.p = x.p group by x.doc_id)
select d.doc_id, len(w) as n_words, coalesce(k.n, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from d left join k on k.doc_id = d.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10_SQL = f"""
with recursive d as (select doc_id, {_WORDS.format(_LOWER)} as w from documents), n as (select doc_id as id from d),
s as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)
  union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4
), z as (select doc_id, count(*) as n from s group by doc_id), l as (
  select p.a, p.b from (select x.doc_id as a, y.doc_id as b, count(*) as both_n from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by all) p
    join z za on za.doc_id = p.a join z zb on zb.doc_id = p.b where 100 * both_n >= 80 * (za.n + zb.n - both_n)
), {_REACH}
select c.id as doc_id, coalesce(z.n, 0) as n_shingles, component_id from c left join z on z.doc_id = c.id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op7_quality_rules": op7_quality_rules,
    "op6_secret_scan": op6_secret_scan,
    "op8_url_filter": op8_url_filter,
    "op2_packing": op2_packing,
    "op9_language_id": op9_language_id,
    "op1_bpe": op1_bpe,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_context_mixing": op4_context_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_lexical_search": op11_lexical_search,
    "op12_curriculum_mix": op12_curriculum_mix,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLE_SQL: dict[str, str] = {"op3_embedding_dedup": OP3_SQL, "op5_substring_dedup": OP5_SQL, "op10_jaccard_join": OP10_SQL, "op7_quality_rules": OP7_SQL, "op8_url_filter": OP8_SQL, "op11_lexical_search": OP11_SQL, "op12_curriculum_mix": OP12_SQL}
