"""The queries of these operators over the given tables, and their SQL where SQL can express them."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reportlake.llm import (
    bpe, centroids, decontaminate, exact_dedup, fim, langid, near_dedup, pii, quality, substring_dedup, suffix_dedup, toxicity, warc,
)
from reportlake.llm.work import held_out

QUERIES = {}
ORACLES = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(oracle: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query()
def op2_langid(spark, folder):
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(~held_out("doc_id")), "doc_id", "text", "lang")
    return langid.predict(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous"
    )


@query()
def op3_toxicity(spark, folder):
    """Toxicity of every document, learned from the labels of the rows that are not held out."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    field = toxicity.fit(docs, labels.where(~held_out("doc_id")))
    return toxicity.score(docs, field).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "spans",
    )


@query(r"""
with t as (
  select 0 kind, doc_id id, text from documents union all select 1, item_id, text from benchmark),
w as (
  select kind, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
  from t),
s as (
  select distinct kind, id, array_to_string(w[i:i + 4], ' ') g
  from (select kind, id, w, unnest(range(1, len(w) - 3)) i from w where len(w) >= 5)),
n as (select id, count(*) n from s where kind = 1 group by id)
select d.id doc_id, b.id item_id, any_value(n.n) n_shingles, count(*) n_found
from s d join s b on d.kind = 0 and b.kind = 1 and d.g = b.g join n on n.id = b.id
group by d.id, b.id having count(*) >= 0.8 * any_value(n.n)""")
def op4_decontaminate(spark, folder):
    """Documents that hold benchmark items."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("""
with n as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
  from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
  doc_id = max(doc_id) over (partition by t) kept, sha256(t) text_sha256
from n""")
def op5_exact_dedup(spark, folder):
    """Keep the last of equal documents."""
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query()
def op6_bpe(spark, folder):
    """Token ids of every document and the text they give back."""
    encoded = bpe.encode(table(spark, folder, "documents"), TOKENIZER)
    digests = encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"), "ids"
    )
    return bpe.decode(digests, TOKENIZER).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256")
    )


@query()
def op8_pii(spark, folder):
    """Personal data of every document."""
    found = pii.find(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
    )


@query()
def op7_near_dedup(spark, folder):
    """Groups of near duplicates."""
    return near_dedup.near_groups(table(spark, folder, "documents"), shingle=4)


@query()
def op1_substring_dedup(spark, folder):
    """Documents without the passages that also stand earlier."""
    done = substring_dedup.drop_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op10_warc(spark, folder):
    """Pages written to archives and read back."""
    return warc.round_trip(table(spark, folder, "pages"))


@query()
def op9_quality(spark, folder):
    """Quality of every document, learned from overlapping heuristics."""
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs))


def kmeans_sql(rounds: int = 10, k: int = 8, seed: int = 3) -> str:
    """The rounds one after another; a centroid is a list of integers."""
    assign = """
  select vec_id, v, arg_min(c, (d, c)) c, min(d) d from (
    select vec_id, n, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from kept, m{0})
  group by n, vec_id, v"""
    steps = "".join(f""",
a{r} as materialized ({assign.format(r)}),
s{r} as materialized (
  select c, i, sum(v[i])::hugeint s, count(*)::hugeint n from a{r}, range(1, 65) t(i) group by c, i),
m{r + 1} as materialized (
  select c, coalesce(any_value(f.m), any_value(m{r}.m)) m from m{r} left join (
    select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) m from s{r} group by c) f using (c) group by c)""" for r in range(rounds))
    return f"""
with kept as materialized (
  select row_number() over () n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
m0 as materialized (
  select row_number() over (order by h, v) - 1 c, v m from (
    select sha256('{seed}:' || vec_id) h, v from kept order by h, v limit {k})){steps},
final as materialized ({assign.format(rounds)})
select vec_id, c::int as "cluster", d::bigint distance, (sum(d) over (partition by c))::bigint cluster_inertia,
  (sum(d) over ())::bigint inertia, sha256(array_to_string(m, ',')) centroid_sha256
from final join m{rounds} using (c)"""


@query(kmeans_sql())
def op11_centroids(spark, folder):
    """Exact k-means of the vectors in integers."""
    return centroids.cluster(table(spark, folder, "embeddings"))


@query("""
with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) t from documents),
w as materialized (
  select r, p, md5(substr(t, 2 * p + 1, 400)) g
  from (select r, t, unnest(range(0, len(t) // 2 - 199)) p from d where len(t) >= 400)),
x as (select r, p from w join (select g from w group by g having count(*) > 1) using (g)),
e as (select r, p, p > lag(p, 1, -1000) over (partition by r order by p) + 200 first from x),
n as (select r, p, sum(first::int) over (partition by r order by p) k from e),
s as (select r, k, min(p) a, max(p) + 200 b from n group by r, k),
g as (
  select r, lag(b, 1, 0) over (partition by r order by a) a, a b from s
  union all select r, max(b), 1000000000 from s group by r),
kept as (select r, string_agg(substr(t, 2 * a + 1, 2 * (b - a)), '' order by a) t from g join d using (r) group by r),
gone as (select r, sum(b - a)::bigint n, count(*) k from s group by r)
select doc_id, len(d.t) // 2 n_bytes, coalesce(n, 0) n_removed, coalesce(k, 0) n_spans,
  sha256(unhex(coalesce(kept.t, d.t))) kept_sha256
from d left join gone using (r) left join kept using (r)""")
def op12_suffix_dedup(spark, folder):
    """Documents without the byte strings that stand more than once."""
    done = suffix_dedup.drop_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(r"""
with t as (
  select doc_id, coalesce(text, '') text, sha256('42:' || doc_id) h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u from documents),
h as (
  select *, len(u) n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3,
    ('0x' || h[25:32])::bigint h4 from t),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50
      then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end form from h),
p as (
  select *, coalesce(array_to_string(u[1:a], ''), '') x, coalesce(array_to_string(u[a + 1:b], ''), '') y,
    coalesce(array_to_string(u[b + 1:], ''), '') z from c)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(x) end prefix_chars,
  case when form <> 'plain' then length(y) end middle_chars,
  sha256(case form when 'plain' then text when 'spm' then '<S>' || z || '<P>' || x || '<M>' || y
    else '<P>' || x || '<S>' || z || '<M>' || y end) output_sha256,
  sha256(text) restored_sha256
from p""")
def op13_fim(spark, folder):
    """Documents with a middle part moved to their end."""
    return fim.digests(fim.fill_in_middle(fim.framed(table(spark, folder, "documents"))))
