"""The pN_ queries of this subpackage and their SQL; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = r"^\s*([0-9]+)\s*-\s*([0-9]+)\s*-\s*[A-Za-z]?\s*$"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from strandflow.llm.posting_lists import similar_pairs

    aa = similar_pairs(read(spark, d, "residues"), "idx", "aa_embeddings").select(F.lit("aa").alias("level"), "id1", "id2")
    seq = similar_pairs(read(spark, d, "seq_emb"), "seqnum", "sequence_embeddings").select(F.lit("seq").alias("level"), "id1", "id2")
    return aa.unionByName(seq)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from strandflow.llm.markov import clique_clusters

    return clique_clusters(read(spark, d, "residues"), "idx", "aa_embeddings").select(F.col("clust").alias("clust_idx"), F.col("id").alias("idx"), "role")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from strandflow.llm.chosen_path import residue_runs, similar_by_vector, similar_sets

    a = similar_sets(residue_runs(read(spark, d, "residues")), 0.6)
    b = similar_by_vector(read(spark, d, "seq_emb"), "seqnum", "sequence_embeddings", 0.985)
    return a.unionByName(b).distinct().select(F.col("a").cast("int").alias("seq1"), F.col("b").cast("int").alias("seq2"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from strandflow.llm.grid_components import connected_groups

    key = lambda s, p: F.shiftleft(s.cast("long"), 32) + p.cast("long")  # noqa: E731  in the order of (seqnum, seqpos)
    rbh = read(spark, d, "rbh")
    label = lambda c: key(F.expr(f"try_cast(regexp_extract({c}, r'{LABEL}', 1) as int)"), F.expr(f"try_cast(regexp_extract({c}, r'{LABEL}', 2) as int)"))
    pairs = rbh.select(label("aa1").alias("u"), label("aa2").alias("v"))
    columns = read(spark, d, "clusters").filter("clustid is not null and clustid <> -1 and seqnum is not null and seqpos is not null").select("clustid", key(F.col("seqnum"), F.col("seqpos")).alias("v")).distinct()
    stars = columns.join(columns.groupBy("clustid").agg(F.min("v").alias("u")), "clustid").select("u", "v")
    parts = lambda c: (F.shiftright(c, 32).cast("int"), F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    (gs, gp), (s, p) = parts("grp"), parts("member")
    return connected_groups(pairs.unionByName(stars)).select(gs.alias("grp_seqnum"), gp.alias("grp_seqpos"), s.alias("seqnum"), p.alias("seqpos"))


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    from strandflow.llm.tokenizer import encode_documents

    return encode_documents(read(spark, d, "documents"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    from strandflow.llm.packing import pack
    from strandflow.llm.tokenizer import count_tokens

    return pack(count_tokens(read(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from strandflow.llm.stuffed import stuffed_documents

    return stuffed_documents(read(spark, d, "documents"))


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_ids": p5_ids, "p6_containers": p6_containers, "p7_found": p7_found}


SQL = {
    "p2_found": """
with aa as (select distinct on (idx) idx as id, aa_embeddings::double[] as v from residues where len(aa_embeddings) = 48 and idx is not null),
u as (select id, v, sqrt(list_dot_product(v, v)) as n from aa where len(list_filter(v, lambda x: x is null or isnan(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
n as materialized (select id, list_transform(v, lambda x: x / n)::double[48] as v from u),
c as materialized (select a.id as q, b.id as t, array_inner_product(a.v, b.v) as c from n a join n b on a.id <> b.id where round(array_inner_product(a.v, b.v), 6) >= 0.90),
s as (select q, list_sort(list_append(list(t), q)) as m, round(avg(c), 6) as mean from c group by q),
g as (select *, count(*) over (partition by m) as same from s),
k as (select m[1] as clust_idx, q as idx, row_number() over (partition by m order by mean desc, q) as rn from g where len(m) >= 3 and same = len(m))
select clust_idx, idx, case when rn = 1 then 'typical' else 'member' end as role from k
""",
    "p3_found": """
with r as (select distinct on (seqnum, seqpos) seqnum, seqpos, upper(coalesce(seqaa, 'X')) as aa from residues where seqnum is not null and seqpos is not null),
t as (select seqnum, aa || lead(aa) over w || lead(aa, 2) over w as k from r window w as (partition by seqnum order by seqpos)),
s as (select distinct seqnum, k, count(distinct k) over (partition by seqnum) as n from t where k is not null),
i as (select a.seqnum as q, b.seqnum as t, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from s a join s b on a.k = b.k and a.seqnum < b.seqnum where a.n >= 10 and b.n >= 10 group by 1, 2),
e as (select distinct on (seqnum) seqnum as id, sequence_embeddings::double[] as v from seq_emb where len(sequence_embeddings) = 48 and seqnum is not null),
u as (select id, v, sqrt(list_dot_product(v, v)) as n from e where len(list_filter(v, lambda x: x is null or isnan(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0)
select q as seq1, t as seq2 from i where c >= 0.6 * (na + nb - c) - 1e-9
union select a.id, b.id from u a join u b on a.id < b.id and round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) >= 0.985
""",
    "p4_found": f"""
with recursive l as (select try_cast(regexp_extract(aa1, '{LABEL}', 1) as bigint) as s1, try_cast(regexp_extract(aa1, '{LABEL}', 2) as bigint) as p1,
  try_cast(regexp_extract(aa2, '{LABEL}', 1) as bigint) as s2, try_cast(regexp_extract(aa2, '{LABEL}', 2) as bigint) as p2 from rbh),
k as (select distinct clustid, seqnum::bigint * 4294967296 + seqpos as v from clusters where clustid is not null and clustid <> -1 and seqnum is not null and seqpos is not null),
e as (select s1 * 4294967296 + p1 as u, s2 * 4294967296 + p2 as v from l where s1 is not null and s2 is not null
  union select min(v) over (partition by clustid), v from k),
b as (select u, v from e where u <> v union select v, u from e where u <> v),
r as (select u as g, u as v from b union select r.g, b.v from r join b on b.u = r.v where r.g < b.v),
m as (select v, min(g) as g from r group by v)
select (g // 4294967296)::int as grp_seqnum, (g % 4294967296)::int as grp_seqpos, (v // 4294967296)::int as seqnum, (v % 4294967296)::int as seqpos from m
""",
}
