"""The registered queries of this package, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, codes, merkle, minhash, mixing, ngram_join, packing, pii, quality, secrets, suffixes, topk, toxicity
from .common import crc_fold, table

#: From here on a document counts as toxic, or as good.
THRESHOLD = 0.3


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(secrets.secrets(table(spark, sf_dir, "documents")), secrets.BASE)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_fold("doc_id", 4) == 2
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = toxicity.scored(docs.select("doc_id", "text"), lexicon)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_fold("doc_id", 5) == 0
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compared(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mixed(docs, column="position").select("doc_id", "source", "position", "position_block", "position_release", "position_deadline")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.alike(table(spark, sf_dir, "documents"), percent=90, words=3)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_personal_data, op2_secret_scan, op3_toxicity, op4_repeated_passages, op5_packing, op6_top_k, op7_quality, op8_fingerprints, op9_mixing, op10_near_duplicates, op11_vector_codes, op12_ngram_join, op13_filter_audit)}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"



def _vector_codes_sql() -> str:
    """Rounds of assignment and update, written out one after the other; p is the part's position, k the entry's."""
    far = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = """with q as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) as q from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as (select vec_id, label, p, q[p * (len(q) // 4) + 1 : (p + 1) * (len(q) // 4)] as v from q, (select unnest(range(4)) as p)),
c0 as (select p, row_number() over (partition by p order by vec_id) - 1 as k, v from (select *, row_number() over (partition by p order by vec_id) as r from x) where r <= 256)"""
    for n in range(5):
        out += f""",
a{n} as (select x.vec_id, x.p, x.v, arg_min(c.k, ({far}, c.k)) as k, min({far}) as far from x join c{n} c on c.p = x.p group by x.vec_id, x.p, x.v)"""
        if n < 4:
            out += f""",
m{n} as (select p, k, list(m order by j) as v from (select p, k, j, cast(floor(sum(v[j]) / count(*)) as bigint) as m from a{n}, (select unnest(range(1, 1 + (select max(len(v)) from x))) as j) group by p, k, j) group by p, k),
c{n + 1} as (select c.p, c.k, coalesce(m.v, c.v) as v from c{n} c left join m{n} m on m.p = c.p and m.k = c.k)"""
    return out + """,
r as (select a.vec_id, any_value(q.label) as label, string_agg(printf('%02x', a.k), '' order by a.p) as code, cast(sum(a.far) as bigint) as error from a4 a join q on q.vec_id = a.vec_id group by a.vec_id),
h as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, k)) as codebooks_sha256 from c4)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from r, h"""


ORACLES = {
    "op11_vector_codes": _vector_codes_sql(),
    "op13_filter_audit": r"""
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
d as (select doc_id, part, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
             coalesce(doc_id > min(doc_id) over (partition by text), false) as e from w),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end as fails,
             count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from d left join l using (doc_id) group by 1, 2),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select p.x || q.x || r.x || s.x || t.x as filter_order from x p, x q, x r, x s, x t where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k as (select filter_order, step, filter_order[1 : step - 1] as before, filter_order[step] as own from o, (select unnest(range(1, 6)) as step)),
r as (select f.*, k.*, contains(fails, own) as bad, len(list_filter(string_split(before, ''), lambda c: c <> '' and contains(fails, c))) > 0 as gone from f, k),
g as (select part, filter_order, step, own, cast(sum(case when gone or bad then 0 else n end) as bigint) as kept, cast(sum(case when bad and not gone then n else 0 end) as bigint) as removed,
             cast(sum(case when bad and gone then n else 0 end) as bigint) as redundant, cast(sum(case when fails = own then n else 0 end) as bigint) as unique_fails,
             cast(sum(case when bad and not gone then good else 0 end) as bigint) as good_lost, cast(sum(case when bad and not gone then toxic else 0 end) as bigint) as toxic_lost from r group by 1, 2, 3, 4)
select part, filter_order, cast(step as int) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from g""",
    "op4_repeated_passages": f"""
with w as (select doc_id, {_WORDS} as words from documents),
g as (select doc_id, s, md5(array_to_string(words[s + 1 : s + 50], ' ')) as h
      from (select doc_id, words, unnest(range(0, len(words) - 49)) as s from w where len(words) >= 50)),
t as (select h, min(doc_id) as low, max(doc_id) as high from g group by h having min(doc_id) < max(doc_id)),
r as (select doc_id, s, case when doc_id = low then high else low end as other from g join t using (h)),
b as (select doc_id, s, case when s <= max(s + 50) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from (select distinct doc_id, s from r)),
n as (select doc_id, s, sum(fresh) over (partition by doc_id order by s) as k from b),
p as (select doc_id, k, cast(min(s) as int) as start_word, cast(max(s) + 50 as int) as end_word from n group by doc_id, k)
select distinct p.doc_id, p.start_word, p.end_word, r.other as other_doc_id from r join n using (doc_id, s) join p using (doc_id, k)""",
    "op6_top_k": """
with q as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.v, b.v) as bigint) as score
      from q a join q b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select * from r where rank <= 20""",
    "op8_fingerprints": """
with d as (select doc_id, coalesce(text, '') as text,
                  coalesce(lead(coalesce(text, '')) over (order by doc_id), first_value(coalesce(text, '')) over (order by doc_id)) as after from documents),
x as (select doc_id, length(text) as n_chars, text, after,
             concat(substring(text, 1, length(text) - length(text) // 2), substring(after, 1, length(text) // 2)) as edited from d),
t as (select doc_id, n_chars, edited, list_transform([text, edited, after], lambda w: list_transform(string_split(w, chr(10) || chr(10)),
             lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?s).{1,48}'), lambda b: substring(md5(b), 1, 16))))) as trees from x),
p as (select *, list_transform(trees, lambda w: list_transform(w, lambda s: list_transform(s, lambda q: substring(md5(array_to_string(q, ',')), 1, 16)))) as ps,
             list_transform(trees, lambda w: case when len(flatten(flatten(w))) = 0 then [''] else list_distinct(flatten(flatten(w))) end) as ls from t),
f as (select *, list_transform(ps, lambda w: sha256(array_to_string(list_transform(w, lambda s: substring(md5(array_to_string(s, ',')), 1, 16)), ',')) || '/' ||
             array_to_string(list_transform(w, lambda s: substring(md5(array_to_string(s, ',')), 1, 16) || ':' || array_to_string(s, '.')), '/')) as fs from p)
select doc_id, n_chars, sha256(edited) as edited_sha256, fs[1] as fingerprint, fs[2] as edited_fingerprint,
       len(list_intersect(ls[1], ls[2]))::double / (len(ls[1]) + len(ls[2]) - len(list_intersect(ls[1], ls[2]))) as near_edited,
       len(list_intersect(ls[1], ls[3]))::double / (len(ls[1]) + len(ls[3]) - len(list_intersect(ls[1], ls[3]))) as near_next from f""",
    "op10_near_duplicates": f"""
with recursive w as (select doc_id, {_WORDS} as words from documents),
g as (select distinct doc_id, md5(array_to_string(words[s + 1 : s + 5], ' ')) as h
      from (select doc_id, words, unnest(range(0, greatest(1, len(words) - 4))) as s from w where len(words) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.h = b.h and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
u as (select a, b from e union all select b, a from e),
r as (select a as id, a as seen from u union select r.id, u.b from r join u on r.seen = u.a),
m as (select id, min(seen) as component_id from r group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.component_id, d.doc_id) as component_id, coalesce(m.component_id, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join m on m.id = d.doc_id""",
    "op12_ngram_join": f"""
with recursive w as (select doc_id, {_WORDS} as words from documents),
g as (select distinct doc_id, md5(array_to_string(words[s + 1 : s + 3], ' ')) as h
      from (select doc_id, words, unnest(range(0, greatest(1, len(words) - 2))) as s from w where len(words) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.h = b.h and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
u as (select a, b from e union all select b, a from e),
r as (select a as id, a as seen from u union select r.id, u.b from r join u on r.seen = u.a),
m as (select id, min(seen) as component_id from r group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.component_id, d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id left join m on m.id = d.doc_id""",
}
