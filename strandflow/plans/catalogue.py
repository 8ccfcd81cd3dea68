"""Named queries over the tables and the SQL they are checked against."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandflow.functions import vectors as V
from strandflow.operators import centrality, chains, columns, communities, doubles, evaluate, filling, graph, hits, order
from strandflow.session import shared_dir
from strandflow.sources import files
from strandflow.sources import tables as T

RES = """r0 as (select distinct on (idx) seqnum, seqindex, seqpos, coalesce(upper(seqaa), 'X') as seqaa, idx, fasta, aa_embeddings::double[] as v from residues
  where idx is not null and seqnum is not null and seqpos is not null),
r as (select * from r0 where len(v) = 48 and len(list_filter(v, lambda x: x is null or isnan(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0)"""
UNIT = "n as materialized (select r.*, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))::double[48] as u from r)"
HITS = f"""{RES}, {UNIT}, p as (select a.fasta, a.idx as q, a.seqnum as q_seq, a.seqpos as q_pos, b.idx as t, b.seqnum as t_seq, b.seqpos as t_pos, round(array_inner_product(a.u, b.u), 6) as sim
  from n a join n b on a.fasta = b.fasta and a.seqnum <> b.seqnum where round(array_inner_product(a.u, b.u), 6) >= 0.7),
h as materialized (select * exclude rn from (select *, row_number() over (partition by q, t_seq order by sim desc, t) as rn from p) where rn = 1)"""
L1 = r"^\s*([0-9]+)\s*-\s*([0-9]+)\s*-\s*([A-Za-z]?)\s*$"
part = lambda c, i: f"try_cast(regexp_extract({c}, '{L1}', {i}) as int)"
MATCH = f"""m0 as (select {part('aa1', 1)} as a, {part('aa1', 2)} as b, {part('aa2', 1)} as c, {part('aa2', 2)} as d, sim from rbh where sim is not null and not isnan(sim)),
m as materialized (select case when (a, b) < (c, d) then a else c end as s1, case when (a, b) < (c, d) then b else d end as p1, case when (a, b) < (c, d) then c else a end as s2,
  case when (a, b) < (c, d) then d else b end as p2, max(sim) as sim from m0 where a is not null and c is not null and (a <> c or b <> d) group by 1, 2, 3, 4)"""
COLS = "k as materialized (select distinct clustid, seqnum, seqpos from clusters where clustid is not null and clustid <> -1 and seqnum is not null and seqpos is not null)"
PLACED = f"{COLS}, o as materialized (select seqnum, seqpos, max(clustid) as clustid from k group by 1, 2)"
BOTH = "e2 as (select s1, p1, s2, p2, sim from m union all select s2, p2, s1, p1, sim from m)"
SEQ = f"""{RES}, l as (select seqnum, min(fasta) as fasta, count(*) as seqlen from r0 group by 1), s0 as (select distinct on (seqnum) seqnum, sequence_embeddings::double[] as v from seq_emb where len(sequence_embeddings) = 48 and seqnum is not null),
s as (select s0.seqnum, fasta, seqlen, v from s0 join l using (seqnum) where len(list_filter(v, lambda x: x is null or isnan(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
y as (select a.seqnum as seq1, b.seqnum as seq2, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) as seqsim, a.seqlen as seqlen1, b.seqlen as seqlen2
  from s a join s b on a.fasta = b.fasta and a.seqnum < b.seqnum)"""
CLEAN = "w as (select seqnum, upper(regexp_replace(seq, '\\s', '', 'g')) as seq, regexp_extract(trim(name), '^(\\S+)', 1) as name, fasta from (select distinct on (seqnum) * from sequences where seqnum is not null))"

_queries, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def _clean(s, d):
    df = T.table(s, d, "sequences").filter("seqnum is not null").dropDuplicates(["seqnum"])
    return df.select("seqnum", F.upper(F.regexp_replace("seq", r"\s", "")).alias("seq"), F.regexp_extract(F.trim("name"), r"^(\S+)", 1).alias("name"), "fasta")


def _placed(s, d):
    return columns.one_column(T.columns(s, d))


def _edges(s, d, least=None):
    m = T.matches(s, d)
    m = m.filter(F.col("sim") >= least) if least is not None else m
    key = lambda a, b: F.shiftleft(F.col(a).cast("long"), 32) + F.col(b)
    return m.select(key("s1", "p1").alias("src"), key("s2", "p2").alias("dst"), F.col("sim").alias("w"))


GE = f"{MATCH}, g as materialized (select s1::bigint * 4294967296 + p1 as src, s2::bigint * 4294967296 + p2 as dst, sim as w from m)"


ISL = f"""recursive {GE}, ib as (select src, dst from g where w >= 0 union select dst, src from g where w >= 0), it as (select src as c, src as v from ib union select it.c, ib.dst from it join ib on ib.src = it.v where it.c < ib.dst),
k as materialized (select min(c) as clustid, (v // 4294967296)::int as seqnum, (v % 4294967296)::int as seqpos from it group by v)"""


def _islands(s, d):
    """Connected matches from 0 up as columns (clustid, seqnum, seqpos); wrong ones give some a sequence twice."""
    part = graph.components(_edges(s, d, 0.0))
    return part.select(F.col("component").alias("clustid"), F.shiftright("vertex", 32).cast("int").alias("seqnum"), F.col("vertex").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("seqpos"))


@query(f"with {CLEAN} select seqnum, name, seq, len(seq) as size from w where len(seq) >= 1")
def fasta_parse(s, d):
    return _clean(s, d).filter(F.length("seq") >= 1).select("seqnum", "name", "seq", F.length("seq").alias("size"))


@query(f"with {CLEAN}, x as (select seqnum, unnest(range(len(seq))) as seqpos, seq from w) select seqnum, seqpos::int as seqpos, substr(seq, seqpos + 1, 1) as seqaa, seqnum || '-' || seqpos || '-' || substr(seq, seqpos + 1, 1) as label from x")
def residue_table(s, d):
    df = _clean(s, d).filter(F.length("seq") >= 1).select("seqnum", F.posexplode(F.split("seq", "")).alias("seqpos", "seqaa")).filter("seqaa <> ''")
    return df.withColumn("label", F.concat_ws("-", "seqnum", "seqpos", "seqaa"))


@query(f"with {RES} select seqnum, seqpos, seqaa, lag(seqaa) over w as prevaa, lead(seqaa) over w as nextaa from r0 window w as (partition by seqnum order by seqpos)")
def prev_next(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("seqnum").orderBy("seqpos")
    return T.residues(s, d, vectors=False).select("seqnum", "seqpos", "seqaa", F.lag("seqaa").over(w).alias("prevaa"), F.lead("seqaa").over(w).alias("nextaa"))


@query("select seqnum, count(*) as residues from (select distinct seqnum, seqpos from residues where seqnum < 20 and seqpos is not null and idx is not null) group by 1")
def seq_limit(s, d, n=20):
    return T.residues(s, d, vectors=False).filter(F.col("seqnum") < n).groupBy("seqnum").agg(F.count("*").alias("residues"))


@query(f"with {RES} select idx, list_transform(v, lambda x: floor(x / sqrt(list_dot_product(v, v)) * 1000000 + 0.5) / 1000000) as emb from r")
def l2_normalise(s, d):
    return T.residues(s, d).select("idx", V.rounded(V.normalise(F.col("emb"))).alias("emb"))


@query(f"with {RES} select idx, list_transform(v, lambda x: floor((x - list_sum(v) / 48) * 1000000 + 0.5) / 1000000) as emb from r")
def mean_centre(s, d):
    return T.residues(s, d).select("idx", V.rounded(V.centre(F.col("emb"))).alias("emb"))


@query(f"with {RES} select idx, list_concat(v[9:16], v[33:40]) as emb from r")
def head_slice(s, d):
    return T.residues(s, d).select("idx", V.heads(F.col("emb"), [1, 4], 8).alias("emb"))


@query(f"with {RES} select idx, list_concat(v[25:48], v[1:24]) as emb from r")
def layer_concat(s, d):
    return T.residues(s, d).select("idx", V.heads(F.col("emb"), [1, 0], 24).alias("emb"))


def _pool(s, d, how):
    """One aggregation of 48 values a sequence."""
    wide = T.residues(s, d, single=True).groupBy("seqnum").agg(F.array(*(F.round(how(F.col("emb")[i].cast("double")), 6) for i in range(T.DIM))).alias("v"))
    return wide.select("seqnum", F.posexplode("v").alias("pos", "value"))


@query(f"with {RES}, x as (select seqnum, unnest(v) as x, unnest(range(48)) as pos from r) select seqnum, pos::int as pos, round(avg(x), 6) as value from x group by 1, 2")
def mean_pool(s, d):
    return _pool(s, d, F.avg)


@query(f"with {RES}, x as (select seqnum, unnest(v) as x, unnest(range(48)) as pos from r) select seqnum, pos::int as pos, round(stddev_pop(x), 6) as value from x group by 1, 2")
def sigma_pool(s, d):
    return _pool(s, d, F.stddev_pop)


@query(f"with {HITS} select * from h")
def best_hits(s, d):
    return hits.best_hits(T.residues(s, d, single=True))


@query(f"with {HITS}, b as materialized (select t as q, q as t from h where q_seq > t_seq) select h.* from h semi join b using (q, t) where q_seq < t_seq")
def rbh(s, d):
    return hits.reciprocal_hits(T.residues(s, d, single=True)).select("fasta", "q", "q_seq", "q_pos", "t", "t_seq", "t_pos", "sim")


@query(f"with {HITS} select q_seq, t_seq, count(*) as hits, round(sum(sim), 6) as sum_sim from h group by 1, 2")
def no_rbh(s, d):
    return hits.best_hits(T.residues(s, d, single=True)).groupBy("q_seq", "t_seq").agg(F.count("*").alias("hits"), F.round(F.sum("sim"), 6).alias("sum_sim"))


@query(f"with {RES}, {UNIT}, p as (select a.idx as q, b.idx as t, round(array_inner_product(a.u, b.u), 6) as sim from n a join n b on a.fasta = b.fasta and a.idx <> b.idx), k as (select *, row_number() over (partition by q order by sim desc, t)::int as rank from p) select * from k where rank <= 5")
def knn_topk(s, d):
    return hits.neighbours(T.residues(s, d, single=True), 5, False, own=True).select("q", "t", "sim", "rank")


@query(f"""with {RES}, {UNIT}, {PLACED}, sc as materialized (select n.* from n where not exists (select 1 from o where o.seqnum = n.seqnum and o.seqpos = n.seqpos)),
p as (select a.idx as q, b.idx as t, b.seqnum as t_seq, round(array_inner_product(a.u, b.u), 6) as sim from sc a join sc b on a.fasta = b.fasta and a.seqnum <> b.seqnum where round(array_inner_product(a.u, b.u), 6) >= 0.5),
x as (select *, row_number() over (partition by q, t_seq order by sim desc, t) as rn from p) select q, t, sim from x where rn = 1""")
def restricted_hits(s, d):
    """Best hits among the residues that have no column, searched inside them alone."""
    res = T.residues(s, d, single=True)
    scope = res.join(_placed(s, d).select("seqnum", "seqpos"), ["seqnum", "seqpos"], "left_anti").select("idx")
    return hits.restricted(res, scope, 0.5).select("q", "t", "sim")


@query(f"with {SEQ} select seq1, seq2, seqsim, seqlen1, seqlen2 from y where seqsim >= 0.7")
def seqsim_edges(s, d):
    return hits.sequence_similarities(T.sequence_vectors(s, d), 0.7).drop("correctedseqsim")


@query(f"with {SEQ} select *, round(seqsim * (1 - abs(0.5 - seqlen1 / (seqlen1 + seqlen2))), 6) as correctedseqsim from y where round(seqsim * (1 - abs(0.5 - seqlen1 / (seqlen1 + seqlen2))), 6) >= 0.7")
def seqsim_corrected(s, d):
    return hits.sequence_similarities(T.sequence_vectors(s, d), 0.7).filter("correctedseqsim >= 0.7")


@query("select distinct least(seq1, seq2) as src, greatest(seq1, seq2) as dst, max(sim) over (partition by least(seq1, seq2), greatest(seq1, seq2)) as w from rbh where seq1 <> seq2 and not isnan(sim) and sim is not null")
def graph_simplify_max(s, d):
    return graph.simplify(T.table(s, d, "rbh").filter("sim is not null and not isnan(sim)").select(F.col("seq1").alias("src"), F.col("seq2").alias("dst"), F.col("sim").alias("w")))


@query(f"with {MATCH} select s1 as src, s2 as dst, round(sum(sim), 6) as w from m where s1 <> s2 group by 1, 2")
def graph_simplify_sum(s, d):
    return graph.simplify(T.matches(s, d).select(F.col("s1").alias("src"), F.col("s2").alias("dst"), F.col("sim").alias("w")), "sum").withColumn("w", F.round("w", 6))


@query(f"with {GE}, x as (select src as vertex, w from g union all select dst, w from g) select vertex, count(*) as degree, round(sum(w), 6) as strength from x group by 1")
def vertex_strength(s, d):
    return graph.strength(_edges(s, d)).withColumn("strength", F.round("strength", 6))


@query(f"with recursive {GE}, b as (select src, dst from g where w >= 0.5 union select dst, src from g where w >= 0.5), t as (select src as c, src as v from b union select t.c, b.dst from t join b on b.src = t.v where t.c < b.dst) select v as vertex, min(c) as component from t group by 1")
def components(s, d):
    return graph.components(_edges(s, d, 0.5))


@query(f"with {ISL}, {BOTH}, x as (select a.clustid as grp, a.seqnum::bigint * 4294967296 + a.seqpos as vertex, sum(sim) as strength from e2 join k a on a.seqnum = s1 and a.seqpos = p1 join k b on b.seqnum = s2 and b.seqpos = p2 and a.clustid = b.clustid group by 1, 2),"
       " z as (select *, count(*) over w as n, sum(strength) over w as t, stddev_pop(strength) over w as sd from x window w as (partition by grp)) select grp, vertex, round(strength, 6) as strength, round(case when n > 3 and sd > 1e-9 then (strength - (t - strength) / (n - 1)) / sd end, 4) as z,"
       " coalesce(case when n > 3 and sd > 1e-9 then (strength - (t - strength) / (n - 1)) / sd end < -5 and strength / (n - 1) <= 0.8, false) as dropped from z")
def seq_outliers(s, d):
    scored = columns.inner_scores(_islands(s, d), T.matches(s, d)).filter("score <> 0")
    return graph.outliers(scored.select(F.col("clustid").alias("grp"), (F.shiftleft(F.col("seqnum").cast("long"), 32) + F.col("seqpos")).alias("vertex"), F.col("score").alias("strength")))


@query(f"with {ISL} select clustid, seqnum, count(*) as times from k group by 1, 2 having count(*) > 1")
def doubled_seqs(s, d):
    return columns.doubled(_islands(s, d))


@query(f"with {ISL} select clustid, count(*) as members, count(distinct seqnum) as sequences, count(*) = count(distinct seqnum) as complete, round(1.2 * count(distinct seqnum), 6)::double as allowed, count(*) > round(1.2 * count(distinct seqnum), 6)::double as over from k group by 1")
def completeness(s, d):
    return columns.completeness(_islands(s, d))


DEDUP = f"{ISL}, {BOTH}, i as (select a.clustid, s1 as seqnum, p1 as seqpos, round(sum(sim), 6) as score from e2 join k a on a.seqnum = s1 and a.seqpos = p1 join k b on b.seqnum = s2 and b.seqpos = p2 and a.clustid = b.clustid group by 1, 2, 3), j as (select k.*, coalesce(score, 0) as score from k left join i using (clustid, seqnum, seqpos))"


@query(f"with {DEDUP}, q as (select *, row_number() over (partition by clustid, seqnum order by score desc, seqpos) as n from j) select clustid, seqnum, seqpos, score from q where n = 1")
def dedup_by_graph(s, d):
    return columns.keep_best(columns.inner_scores(_islands(s, d), T.matches(s, d)))


@query(f"with {COLS}, x as (select *, count(*) over (partition by seqnum, seqpos) as n from k) select clustid, seqnum, seqpos from x where n = 1")
def shared_residue_removal(s, d):
    return columns.unshared(T.columns(s, d))


@query(f"with {COLS}, z as (select clustid, count(*) as n from k group by 1), x as (select a.clustid, b.clustid as o, count(*) as c from k a join k b on a.seqnum = b.seqnum and a.seqpos = b.seqpos and a.clustid <> b.clustid group by 1, 2), i as (select x.clustid from x join z a on a.clustid = x.clustid join z b on b.clustid = x.o where c = a.n and (b.n > a.n or x.clustid > x.o)) select clustid, n as members from z where clustid not in (from i)")
def subset_removal(s, d):
    return columns.without_subsets(T.columns(s, d))


@query(f"with {COLS}, old as (select * from k where clustid % 2 = 0), new as (select * from k where clustid % 2 = 1) select distinct clustid from new where clustid not in (select n.clustid from new n join old using (seqnum, seqpos))")
def overlap_removal(s, d):
    k = T.columns(s, d)
    old, new = k.filter("clustid % 2 = 0"), k.filter("clustid % 2 = 1")
    return new.select("clustid").distinct().join(new.join(old.select("seqnum", "seqpos"), ["seqnum", "seqpos"], "left_semi").select("clustid"), "clustid", "left_anti")


OE = f"{PLACED}, x as (select *, lead(clustid) over (partition by seqnum order by seqpos) as nx, lag(clustid) over (partition by seqnum order by seqpos) as pv from o), oe as (select clustid as c1, nx as c2, count(*) as weight from x where nx is not null and nx <> clustid group by 1, 2)"


@query(f"with {OE} select * from oe")
def order_edges(s, d):
    return columns.order_edges(_placed(s, d))


@query(f"with {OE}, z as (select clustid, count(*) as n from o group by 1), b as (select *, row_number() over (partition by c1 order by weight desc, c2) as rn from oe) select c1, c2, weight from b join z on z.clustid = c1 where rn = 1 and weight >= 0.5 * n")
def consensus_vote(s, d):
    return columns.vote(_placed(s, d))


@query(f"with {OE} select seqnum, list(clustid order by seqpos) as path from o group by 1")
def cluster_paths(s, d):
    p = _placed(s, d)
    return p.groupBy("seqnum").agg(F.transform(F.array_sort(F.collect_list(F.struct("seqpos", "clustid"))), lambda x: x["clustid"]).alias("path"))


FL = f"{RES}, {PLACED}, f as (select r0.seqnum, r0.seqpos, clustid, last_value(clustid ignore nulls) over (partition by r0.seqnum order by r0.seqpos rows between unbounded preceding and 1 preceding) as prev_clust, first_value(clustid ignore nulls) over (partition by r0.seqnum order by r0.seqpos rows between 1 following and unbounded following) as next_clust, count(clustid) over (partition by r0.seqnum order by r0.seqpos rows between unbounded preceding and current row) as rk from r0 left join o on o.seqnum = r0.seqnum and o.seqpos = r0.seqpos)"


@query(f"with {FL} select seqnum, prev_clust, next_clust, min(seqpos) as first, max(seqpos) as last, count(*) as size from f where clustid is null group by seqnum, rk, prev_clust, next_clust")
def gaps(s, d):
    return columns.gaps(T.residues(s, d, vectors=False), _placed(s, d))


@query(f"with {FL} select seqnum, seqpos, prev_clust, next_clust from f where clustid is null and prev_clust < next_clust")
def ranges(s, d):
    return columns.flanks(T.residues(s, d, vectors=False), _placed(s, d)).filter("clustid is null and prev_clust < next_clust").select("seqnum", "seqpos", "prev_clust", "next_clust")


@query(f"with {FL}, {MATCH}, {BOTH}, b as (select f.seqnum, f.seqpos, o.clustid, avg(sim) as mean from f join e2 on s1 = f.seqnum and p1 = f.seqpos join o on o.seqnum = s2 and o.seqpos = p2 where f.clustid is null and (prev_clust is null or prev_clust < o.clustid) and (next_clust is null or o.clustid < next_clust) group by 1, 2, 3), q as (select *, row_number() over (partition by seqnum, seqpos order by round(mean, 6) desc, clustid) as n from b where round(mean, 6) > 0.5) select seqnum, seqpos, clustid, round(mean, 6) as mean_sim from q where n = 1")
def gap_best_cluster(s, d):
    from pyspark.sql import Window

    m, placed = T.matches(s, d), _placed(s, d)
    both = m.unionByName(m.select(F.col("s2").alias("s1"), F.col("p2").alias("p1"), F.col("s1").alias("s2"), F.col("p1").alias("p2"), "sim"))
    open_ = columns.flanks(T.residues(s, d, vectors=False), placed).filter("clustid is null").select(F.col("seqnum").alias("s1"), F.col("seqpos").alias("p1"), "prev_clust", "next_clust")
    to = placed.select(F.col("seqnum").alias("s2"), F.col("seqpos").alias("p2"), "clustid")
    near = both.join(open_, ["s1", "p1"]).join(to, ["s2", "p2"]).filter("(prev_clust is null or prev_clust < clustid) and (next_clust is null or clustid < next_clust)")
    mean = near.groupBy(F.col("s1").alias("seqnum"), F.col("p1").alias("seqpos"), "clustid").agg(F.round(F.avg("sim"), 6).alias("mean_sim")).filter("mean_sim > 0.5")
    return mean.withColumn("n", F.row_number().over(Window.partitionBy("seqnum", "seqpos").orderBy(F.desc("mean_sim"), "clustid"))).filter("n = 1").drop("n")


LEV = f"""recursive {OE}, rc(a, b) as (select c1, c2 from oe union select rc.a, oe.c2 from rc join oe on oe.c1 = rc.b), cy as materialized (select x.a as v, min(x.b) as cycle from rc x join rc y on y.a = x.b and y.b = x.a group by 1),
mp as (select clustid, round(avg(seqpos), 9) as x from o group by 1), ka as materialized (select c1, c2 from oe join mp m1 on m1.clustid = c1 join mp m2 on m2.clustid = c2 left join cy y1 on y1.v = c1 left join cy y2 on y2.v = c2
  where y1.cycle is null or y2.cycle is null or y1.cycle <> y2.cycle or (m1.x, c1) < (m2.x, c2)),
ld(v, d) as (select clustid, 0 from mp where clustid not in (select c2 from ka) union select c2, d + 1 from ld join ka on c1 = v), lv as materialized (select v as clustid, max(d) as level, any_value(cycle) as cycle from ld left join cy using (v) group by 1),
od as (select clustid, (row_number() over (order by level, clustid) - 1)::int as col from lv)"""


@query(f"with {LEV} select clustid, level::bigint as level, cycle from lv")
def column_levels(s, d):
    """The longest way to each column along the order graph, and the cyclic part it is in (null: none)."""
    return order.levels(_placed(s, d))


@query(f"with {LEV}, e as (select c1 as a, c2 as b from oe union select c2, c1 from oe), w(c, v) as (select a, a from e union select w.c, e.b from w join e on e.a = w.v where w.c < e.b), g as (select v, min(c) as component from w group by 1) select component, count(*) as columns, count(cycle) > 0 as cyclic from g join lv on clustid = v group by 1")
def dag_test(s, d):
    """Of each connected part of the order graph whether it has a cycle."""
    placed = _placed(s, d)
    arcs = columns.order_edges(placed).select(F.col("c1").alias("src"), F.col("c2").alias("dst"))
    return graph.components(arcs).join(order.levels(placed).withColumnRenamed("clustid", "vertex"), "vertex").groupBy(F.col("component").cast("int").alias("component")).agg(F.count("*").alias("columns"), (F.count("cycle") > 0).alias("cyclic"))


@query(f"with {LEV} select * from od")
def column_order(s, d):
    return order.column_order(_placed(s, d))


@query(f"with {LEV} select c1, c2, weight from oe join od a on a.clustid = c1 join od b on b.clustid = c2 where a.col > b.col")
def feedback_arcs(s, d):
    placed = _placed(s, d)
    return order.feedback_arcs(placed, order.column_order(placed))


@query(f"with {LEV}, bt as (select c1 as c, weight from oe union all select c2, weight from oe), f as (select c1, c2 from oe join od a on a.clustid = c1 join od b on b.clustid = c2 where a.col > b.col), st as (select c, sum(weight) as s from bt group by 1), w as (select case when a.s >= 2 * b.s then c2 when b.s >= 2 * a.s then c1 end as clustid from f join st a on a.c = c1 join st b on b.c = c2) select distinct clustid from w where clustid is not null")
def weaker_ends(s, d):
    placed = _placed(s, d)
    return order.weaker_ends(order.feedback_arcs(placed, order.column_order(placed)), placed)


@query()
def consistent_members(s, d):
    placed = _placed(s, d)
    return order.consistent(placed, order.column_order(placed))


DBL = f"""{ISL}, one as (select seqnum, seqpos, max(clustid) as c from k group by 1, 2), y as materialized (select k.*, p.c as p, n.c as n, count(*) over (partition by clustid, k.seqnum) as times from k left join one p on p.seqnum = k.seqnum and p.seqpos = k.seqpos - 1 left join one n on n.seqnum = k.seqnum and n.seqpos = k.seqpos + 1)"""
CONSISTENT = f"""{DBL}, gs as (select clustid, count(p) as np, count(n) as nn, count(distinct p) as dp, count(distinct n) as dn from y where times = 1 group by 1),
ip as (select distinct clustid, p from y where times = 1 and p is not null), jn as (select distinct clustid, n from y where times = 1 and n is not null),
v as (select y.clustid, y.seqnum, y.seqpos, coalesce(dp, 0) + (y.p is not null and ip.p is null)::int as kp, coalesce(np, 0) + (ip.p is not null)::int as sp, coalesce(dn, 0) + (y.n is not null and jn.n is null)::int as kn, coalesce(nn, 0) + (jn.n is not null)::int as sn
  from y left join gs using (clustid) left join ip on ip.clustid = y.clustid and ip.p = y.p left join jn on jn.clustid = y.clustid and jn.n = y.n where times > 1),
t as (select *, min(greatest(1, least(kp, kn))) over (partition by clustid, seqnum) as i from v), u as (select *, case when i <= 5 and least(kp, kn) <= i then case when kp <= i then sp else 0 end + case when kn <= i then sn else 0 end end as support from t),
b as (select *, max(support) over (partition by clustid, seqnum) as best from u), q as (select *, sum((support = best)::int) over (partition by clustid, seqnum) as winners from b)"""


@query(f"with {CONSISTENT} select clustid, seqnum, seqpos from y where times = 1 union all select clustid, seqnum, seqpos from q where coalesce(winners, 0) <> 1 or support = best")
def doubles_by_consistency(s, d):
    return doubles.by_consistency(_islands(s, d))


SCORED = f"{ISL}, {BOTH}, y as materialized (select *, count(*) over (partition by clustid, seqnum) as times from k), z as (select a.clustid, a.seqnum, a.seqpos, round(sum(sim), 6) as score from y a join e2 on s1 = a.seqnum and p1 = a.seqpos join y b on b.clustid = a.clustid and b.seqnum = s2 and b.seqpos = p2 and b.times = 1 where a.times > 1 group by 1, 2, 3), q as (select *, row_number() over (partition by clustid, seqnum order by score desc, seqpos) as rn from z where score > 0)"


@query(f"with {SCORED} select clustid, seqnum, seqpos from y where times = 1 union all select clustid, seqnum, seqpos from q where rn = 1")
def doubles_by_scores(s, d):
    return doubles.by_scores(_islands(s, d), T.matches(s, d))


@query()
def first_dedup(s, d):
    """Connected matches as columns without doubles."""
    return doubles.first_pass(_islands(s, d), T.matches(s, d))


@query()
def clustered(s, d):
    """Columns of the matches from 0 up, over-large ones taken apart."""
    m = T.matches(s, d).filter("sim >= 0")
    key = lambda a, b: F.shiftleft(F.col(a).cast("long"), 32) + F.col(b)
    seqs = m.select(key("s1", "p1").alias("vertex"), F.col("s1").alias("seqnum")).unionByName(m.select(key("s2", "p2").alias("vertex"), F.col("s2").alias("seqnum"))).distinct()
    return doubles.taken_apart(_edges(s, d, 0.0), seqs)


@query(f"with {RES}, {PLACED} select seqnum, seqpos, -idx - 2 as clustid from r0 where not exists (select 1 from o where o.seqnum = r0.seqnum and o.seqpos = r0.seqpos)")
def singleton_columns(s, d):
    return filling.singletons(T.residues(s, d, vectors=False), _placed(s, d))


@query()
def gap_islands(s, d):
    """Open residues of each file by groups of overlapping gaps."""
    res, placed = T.residues(s, d, vectors=False), _placed(s, d)
    placed = placed.join(res.select("seqnum", "fasta").distinct(), "seqnum")
    o = order.column_order(placed, group="fasta")
    return filling.gap_islands(filling.open_residues(res, placed, o), placed, o, res)


@query(f"with recursive {GE}, e as (select src, dst from g where w >= 0.5 union select dst, src from g where w >= 0.5), wk as (select distinct src as s, src as v, 0 as l, 1.0::double as n from e union all select s, dst, l + 1, sum(n) from wk join e on src = v where l < 40 group by s, dst, l),"
       " sp as materialized (select s, v, min(l) as d, arg_min(n, l) as n from wk group by 1, 2), b as (select x.v, sum(x.n * y.n / z.n) / 2 as b from sp x join sp y on y.s = x.v join sp z on z.s = x.s and z.v = y.v where x.s <> x.v and y.v <> x.v and x.s <> y.v and x.d + y.d = z.d group by 1), c as (select s as v, count(*) as n from sp group by 1)"
       " select v as vertex, n, round(case when n > 2 then coalesce(b, 0) / ((n - 1) * (n - 2) / 2) else 0 end, 6) as betweenness from c left join b using (v)")
def betweenness(s, d):
    return centrality.betweenness(_edges(s, d, 0.5))


@query()
def hub_scores(s, d):
    return centrality.hub_scores(_edges(s, d, 0.5)).withColumn("hub", F.round("hub", 4))


@query()
def sequence_groups(s, d):
    """Groups of similar sequences of each file; put aside ones have no group."""
    sims = hits.sequence_similarities(T.sequence_vectors(s, d), 0.7).filter("correctedseqsim >= 0.7")
    return communities.sequence_groups(sims.select(F.col("seq1").alias("src"), F.col("seq2").alias("dst"), F.col("correctedseqsim").alias("w")))


@query()
def aligned(s, d):
    """The whole alignment: every residue with its column."""
    from strandflow.plans.align import align

    return align(T.residues(s, d, single=True))


@query()
def aligned_in_groups(s, d):
    """The whole alignment, the similar sequences of a file aligned in groups that are merged in the end."""
    from strandflow.plans.align import align

    return align(T.residues(s, d, single=True), group=0.7)


FILES = "sf as (select distinct seqnum, fasta from r0), fc as materialized (select fasta, clustid, (row_number() over (partition by fasta order by col) - 1)::int as col from od join (select clustid, min(fasta) as fasta from o join sf using (seqnum) group by 1) using (clustid))"


def _files(s, d, placed):
    return placed.join(T.residues(s, d, vectors=False).select("seqnum", "fasta").distinct(), "seqnum")


def _rows(s, d):
    placed = _placed(s, d)
    return columns.alignment(placed, T.residues(s, d, vectors=False), columns.by_file(order.column_order(placed), _files(s, d, placed)))


ALN = f"with {LEV}, {RES}, {FILES}, a as (select fc.fasta, o.seqnum, fc.col, arg_min(r0.seqaa, o.seqpos) as aa from o join r0 on r0.seqnum = o.seqnum and r0.seqpos = o.seqpos join fc on fc.clustid = o.clustid group by 1, 2, 3), t as (select s.fasta, s.seqnum, fc.col, coalesce(aa, '-') as aa from (select distinct fasta, seqnum from a) s join fc using (fasta) left join a on a.fasta = s.fasta and a.seqnum = s.seqnum and a.col = fc.col), aln as (select fasta, seqnum, string_agg(aa, '' order by col) as \"row\" from t group by 1, 2)"


@query(f"{ALN} select * from aln")
def alignment_rows(s, d):
    """The alignment of each file as rows, its columns in their order."""
    return _rows(s, d)


@query(f"{ALN} select seqnum, (row_number() over (partition by seqnum, fasta order by p) - 1)::int as seqpos, (p - 1)::int as clustid, fasta from (select fasta, seqnum, unnest(range(1, len(\"row\") + 1)) as p, \"row\" from aln) where substr(\"row\", p, 1) <> '-'")
def columns_from_alignment(s, d):
    """The columns read back from the alignment of each file."""
    rows = _rows(s, d).withColumn("key", F.struct("fasta", "seqnum"))
    back = columns.from_alignment(rows.select(F.col("key").alias("seqnum"), "row"))
    return back.select("seqnum.seqnum", "seqpos", "clustid", "seqnum.fasta")


@query(f"with {RES}, {PLACED}, z as (select seqnum, count(*) as placed, count(distinct clustid) as cols from o group by 1), n as (select seqnum, count(*) as residues from r0 group by 1) select seqnum, residues, coalesce(placed, 0) as assigned, (select count(distinct clustid) from o) - coalesce(cols, 0) as gap_cells from n left join z using (seqnum)")
def alignment_stats(s, d):
    placed = _placed(s, d)
    width = placed.agg(F.count_distinct("clustid").alias("width"))
    mine = placed.groupBy("seqnum").agg(F.count("*").alias("assigned"), F.count_distinct("clustid").alias("cols"))
    df = T.residues(s, d, vectors=False).groupBy("seqnum").agg(F.count("*").alias("residues")).join(mine, "seqnum", "left").crossJoin(F.broadcast(width))
    return df.select("seqnum", "residues", F.coalesce("assigned", F.lit(0)).alias("assigned"), (F.col("width") - F.coalesce("cols", F.lit(0))).alias("gap_cells"))


@query(f"with {LEV}, st as (select clustid, col, seqpos, lag(col) over w as pc, lag(seqpos) over w as pp, lead(col) over w as nc, lead(seqpos) over w as np from o join od using (clustid) window w as (partition by seqnum order by seqpos)) select distinct clustid from st where not coalesce(pc = col - 1 and pp = seqpos - 1, false) and not coalesce(nc = col + 1 and np = seqpos + 1, false)")
def stranded_columns(s, d):
    placed = _placed(s, d)
    return columns.stranded(placed, order.column_order(placed))


@query(f"with {LEV}, {MATCH}, {BOTH}, a as (select * from o join od using (clustid)), cl as (select distinct x.col from a x join a y on y.col = x.col + 1 and y.seqnum = x.seqnum) select x.col as c1, x.col + 1 as c2, round(sum(sim), 6) as weight from e2 join a x on x.seqnum = s1 and x.seqpos = p1 join a y on y.seqnum = s2 and y.seqpos = p2 where sim > 0 and y.col = x.col + 1 and x.col not in (from cl) group by x.col")
def squish_candidates(s, d):
    placed = _placed(s, d)
    return columns.squish_candidates(placed, order.column_order(placed), T.matches(s, d))


def _chain_sql(least, step):
    state = f"struct_pack(p1 := n.p1, p2 := n.p2, l := {step})"
    return f"""with recursive {MATCH}, n as materialized (select *, row_number() over (partition by s1, s2 order by p1, p2) as i from m where sim {least} and s1 <> s2), r as (select s1, s2, i, [{state}] as st from n where i = 1
union all select n.s1, n.s2, n.i, list_append(r.st, struct_pack(p1 := n.p1, p2 := n.p2, l := {step} + coalesce(list_max(list_transform(list_filter(r.st, lambda x: x.p1 < n.p1 and x.p2 < n.p2), lambda x: x.l)), 0))) from r join n on n.s1 = r.s1 and n.s2 = r.s2 and n.i = r.i + 1),
f as (select s1, s2, arg_max(st, i) as st from r group by 1, 2) select s1, s2, """


@query(_chain_sql(">= 0.7", "1") + "list_max(list_transform(st, lambda x: x.l))::bigint as value from f")
def lis_length(s, d):
    """The length of the longest non-crossing chain of each pair of sequences."""
    return chains.chain_sizes(T.matches(s, d).filter("sim >= 0.7"))


@query(_chain_sql("> 0", "n.sim") + "round(list_max(list_transform(st, lambda x: x.l)), 6) as value from f")
def mnc_weight(s, d):
    """The weight of the heaviest non-crossing chain of each pair of sequences."""
    return chains.chain_sizes(T.matches(s, d).filter("sim > 0"), weighted=True)


@query()
def increasing_hits(s, d):
    return chains.increasing_hits(T.matches(s, d).filter("sim > 0"))


def _file(s, name):
    """A new folder in the shared one."""
    return f"{shared_dir(s)}/file-{name}-{uuid.uuid4().hex}"


@query(f"with {CLEAN}, x as (select 's' || seqnum as name, substr(seq, 1, 30) as seq from w where len(substr(seq, 1, 30)) >= 5) select name, seq, 'X X ' || array_to_string(string_split(seq, ''), ' ') || ' X X' as spaced from x")
def fasta_scan(s, d):
    """The sequences written as FASTA and read back, cut to 30 letters, from 5 letters on, two X at the ends."""
    path = _file(s, "fasta")
    T.write_fasta(_clean(s, d).filter("seq <> ''").select(F.concat(F.lit("s"), "seqnum", F.lit(" of the file")).alias("name"), "seq"), path)
    return T.read_fasta(s, path, truncate=30, minlength=5, padding=2).select("name", "seq", "spaced")


@query(f"with {CLEAN} select case when len(seq) >= 10 then fasta else 'excluded' end as grp, 's' || seqnum as name, seq from w where seq <> ''")
def group_fasta(s, d):
    """A FASTA file for the sequences of each file, one for those left out as too short, read back with the name of the group."""
    path = _file(s, "groups")
    files.write_group_fasta(_clean(s, d).filter("seq <> ''").select(F.when(F.length("seq") >= 10, F.col("fasta")).alias("grp"), F.concat(F.lit("s"), "seqnum").alias("name"), "seq"), path)
    return T.read_fasta(s, f"{path}/*").select(F.regexp_extract(F.url_decode("path"), "/grp=([^/]*)/", 1).alias("grp"), "name", "seq")


@query(f"with {SEQ} select *, round(seqsim * (1 - abs(0.5 - seqlen1 / (seqlen1 + seqlen2))), 6) as correctedseqsim from y where seqsim >= 0.7")
def similarity_csv(s, d):
    """The similar sequences written as CSV and read back."""
    path = _file(s, "similar")
    files.write_similarities(hits.sequence_similarities(T.sequence_vectors(s, d), 0.7), path)
    return files.read_csv(s, path, files.SIMILARITIES, header=True).drop("path")


@query(f"with {MATCH} select fasta, count(*) as n, round(sum(sim), 6) as weight, count(distinct s1 || '-' || p1 || '-') as first from m join (select distinct seqnum, fasta from residues) on seqnum = s1 where sim >= 0.7 group by 1")
def matches_csv(s, d):
    """The matches written as CSV into a folder for each file and read back with the name of the folder."""
    path = _file(s, "matches")
    m = T.matches(s, d).filter("sim >= 0.7").join(T.table(s, d, "residues").select(F.col("seqnum").alias("s1"), "fasta").distinct(), "s1")
    label = lambda a, b: F.concat_ws("-", a, b, F.lit(""))
    files.write_matches(m.select("fasta", F.col("s1").alias("seq1"), F.col("s2").alias("seq2"), label("s1", "p1").alias("aa1"), label("s2", "p2").alias("aa2"), F.col("sim").alias("weight")), path)
    back = files.read_csv(s, path, files.MATCHES)
    return back.filter(F.col("path").contains("/file-matches-")).groupBy("fasta").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"), F.count_distinct("aa1").alias("first"))


@query("select regexp_replace(fasta, '[.]fasta$', '') as source, count(*) as n, max(seq) as last from sequences where seqnum is not null group by 1")
def csv_with_file_name(s, d):
    """The sequences written as a CSV folder for each file, all read at once, each row with the name of where it stood."""
    path = _file(s, "many")
    T.table(s, d, "sequences").filter("seqnum is not null").select("seqnum", F.hex("seq").alias("seq"), F.regexp_replace("fasta", r"[.]fasta$", "").alias("source")).write.partitionBy("source").csv(path)
    back = files.read_csv(s, f"{path}/*", "seqnum int, seq string").withColumn("source", F.regexp_extract("path", "/source=([^/]*)/", 1))
    return back.groupBy("source").agg(F.count("*").alias("n"), F.max(F.unhex("seq").cast("string")).alias("last"))


@query(f"with {LEV}, {RES}, mb as (select clustid, string_agg(lb, '_' order by lb) as aas from (select clustid, o.seqnum || '-' || o.seqpos || '-' || seqaa as lb from o join r0 on r0.seqnum = o.seqnum and r0.seqpos = o.seqpos) group by 1) select c1, c2, x.aas as aas1, y.aas as aas2, a.col as gidx1, b.col as gidx2, weight, case when a.col > b.col then 'yes' else 'no' end as feedback from oe join od a on a.clustid = c1 join od b on b.clustid = c2 join mb x on x.clustid = c1 join mb y on y.clustid = c2")
def order_network_csv(s, d):
    """The order graph with its members and feedback arcs, written as CSV and read back."""
    path = _file(s, "network")
    files.order_network(_placed(s, d), T.residues(s, d, vectors=False)).write.csv(path, header=True)
    return files.read_csv(s, path, files.NETWORK, header=True).drop("path")


@query(f"{ALN}, bl as (select fasta, seqnum, \"row\", unnest(range((len(\"row\") - 1) // 50 + 1)) as b from aln), ln as (select fasta, rpad('s' || seqnum, 36, ' ') || substr(\"row\", b * 50 + 1, 50) as line from bl union all select distinct fasta, '' from (select distinct fasta, b from bl) union all select distinct fasta, 'CLUSTAL X (1.81) multiple sequence alignment' from aln) select fasta, line, count(*) as n from ln where line <> '' group by 1, 2")
def clustal_alignment(s, d):
    """The alignments written in Clustal format and read back line by line."""
    path = _file(s, "clustal")
    files.write_clustal(_rows(s, d).withColumn("name", F.concat(F.lit("s"), "seqnum")), path)
    lines = s.read.text(f"{path}/*").select(F.regexp_extract(F.url_decode("_metadata.file_path"), "/fasta=([^/]*)/", 1).alias("fasta"), F.col("value").alias("line"))
    return lines.filter("line <> ''").groupBy("fasta", "line").agg(F.count("*").alias("n"))


@query()
def pca_csv(s, d):
    """Seven principal coordinates of the residues by a model that was saved and loaded, written as CSV and read back."""
    from pyspark.ml import PipelineModel

    from strandflow.operators import reduce

    res, path = T.residues(s, d), _file(s, "pca")
    reduce.pca_model(res, 7).write().save(f"{path}/model")
    files.pca_coordinates(reduce.apply_pca(PipelineModel.load(f"{path}/model"), res)).write.csv(f"{path}/csv", header=True)
    return files.read_csv(s, f"{path}/csv", "idx long, seqnum int, seqpos int, seqaa string, " + ", ".join(f"x{i} double" for i in range(1, 8)), header=True).drop("path")


@query("with x as (select seqnum, seqpos, sim from (select seq1 as seqnum, seq2 as seqpos, sim from rbh where sim is not null and not isnan(sim) and seq1 is not null and seq2 is not null)) select seqnum, seqpos, sim, row_number() over (order by sim desc, seqnum, seqpos)::int as place from x qualify place <= 20")
def eval_arrange_head(s, d):
    """The 20 best matches, in order."""
    df = T.table(s, d, "rbh").filter("sim is not null and not isnan(sim) and seq1 is not null and seq2 is not null").select(F.col("seq1").alias("seqnum"), F.col("seq2").alias("seqpos"), "sim")
    return evaluate.head(df, 20, F.desc("sim"), F.col("seqnum"), F.col("seqpos"))


@query()
def eval_sample(s, d):
    """100 sequences drawn at random with a seed."""
    return evaluate.sample(T.table(s, d, "sequences").select("seqnum", "fasta").filter("seqnum is not null").dropDuplicates(["seqnum"]), 100, "seqnum")


@query("select fasta, round_even(avg(sim), 1) as mean from rbh where sim is not null and not isnan(sim) group by 1")
def eval_bround(s, d):
    """Means rounded to one place, halves to the even digit."""
    return T.table(s, d, "rbh").filter("sim is not null and not isnan(sim)").groupBy("fasta").agg(F.bround(F.avg("sim"), 1).alias("mean"))


@query("select least(seq1, seq2) as src, greatest(seq1, seq2) as dst, arg_min(sim, (aa1, aa2, sim)) as w from rbh where seq1 <> seq2 and sim is not null and not isnan(sim) and aa1 is not null and aa2 is not null group by 1, 2")
def graph_simplify_first(s, d):
    df = T.table(s, d, "rbh").filter("sim is not null and not isnan(sim) and aa1 is not null and aa2 is not null")
    return graph.simplify(df.select(F.col("seq1").alias("src"), F.col("seq2").alias("dst"), F.col("sim").alias("w"), F.struct("aa1", "aa2", "sim").alias("at")), "first")


@query("select seq1, seq2, aa1, aa2, case when sim < 0 then 0.001 else sim end as sim from rbh where sim is not null and not isnan(sim) and seq1 is not null")
def clamped_matches(s, d):
    """Matches with negative similarities raised to 0.001."""
    return T.table(s, d, "rbh").filter("sim is not null and not isnan(sim) and seq1 is not null").select("seq1", "seq2", "aa1", "aa2", hits.clamped(F.col("sim")).alias("sim"))


@query()
def pca_reduce(s, d):
    from strandflow.operators import reduce

    return reduce.pca(T.residues(s, d), 8).select("idx", "reduced")


@query()
def combat(s, d):
    from strandflow.operators import reduce

    return reduce.combat(T.residues(s, d).select("fasta", "seqnum", "idx", "emb")).select("idx", V.rounded(F.col("emb"), 4).alias("emb"))


LAB = "select distinct protein, aa1, aa2, label from labels_ref where label is not null"
FND = f"select distinct fasta as protein, trim(aa1) as aa1, trim(aa2) as aa2 from rbh where sim >= 0.7 and not isnan(sim) and aa1 is not null and aa2 is not null"


def _labels(s, d):
    return T.table(s, d, "labels_ref").filter("label is not null").select("protein", "aa1", "aa2", "label").distinct()


def _found(s, d):
    return T.table(s, d, "rbh").filter("sim >= 0.7 and not isnan(sim) and aa1 is not null and aa2 is not null").select(F.col("fasta").alias("protein"), F.trim("aa1").alias("aa1"), F.trim("aa2").alias("aa2")).distinct()


@query(f"select f.protein, f.aa1, f.aa2, l.label from ({FND}) f left join ({LAB}) l using (protein, aa1, aa2)")
def eval_label_join(s, d):
    return _found(s, d).join(_labels(s, d), ["protein", "aa1", "aa2"], "left")


@query(f"select coalesce(f.protein, l.protein) as protein, coalesce(f.aa1, l.aa1) as aa1, coalesce(f.aa2, l.aa2) as aa2, l.label, f.aa1 is not null as hit from ({FND}) f full join ({LAB}) l on f.protein = l.protein and f.aa1 = l.aa1 and f.aa2 = l.aa2")
def eval_full_join(s, d):
    return _found(s, d).withColumn("h", F.lit(True)).join(_labels(s, d), ["protein", "aa1", "aa2"], "full").select("protein", "aa1", "aa2", "label", F.coalesce("h", F.lit(False)).alias("hit"))


@query(f"select l.* from ({LAB}) l where not exists (select 1 from ({FND}) f where f.protein = l.protein and f.aa1 = l.aa1 and f.aa2 = l.aa2)")
def eval_anti_join(s, d):
    return _labels(s, d).join(_found(s, d), ["protein", "aa1", "aa2"], "left_anti")


@query(f"with b as (select l.protein, l.label, f.aa1 is not null as hit from ({LAB}) l left join ({FND}) f on f.protein = l.protein and f.aa1 = l.aa1 and f.aa2 = l.aa2), n as (select protein, count(*) filter (hit and label = 1) as tp, count(*) filter (hit and label <> 1) as fp, count(*) filter (not hit and label = 1) as fn from b group by 1),"
       " p as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as r from n) select protein, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as f1 from p")
def precision_recall_f1(s, d):
    return evaluate.scores(_found(s, d), _labels(s, d))


@query("select fasta, round(avg(case when sim >= 0.7 then 1 else 0 end), 6) as share, count(*) as n from rbh where sim is not null and not isnan(sim) group by 1")
def eval_prop_correct(s, d):
    return T.table(s, d, "rbh").filter("sim is not null and not isnan(sim)").groupBy("fasta").agg(F.round(F.avg(F.when(F.col("sim") >= 0.7, 1).otherwise(0)), 6).alias("share"), F.count("*").alias("n"))


@query("select o_custkey, round(max(o_totalprice) filter (o_orderpriority = '1-URGENT'), 6) as \"1-URGENT\", round(max(o_totalprice) filter (o_orderpriority = '2-HIGH'), 6) as \"2-HIGH\", round(max(o_totalprice) filter (o_orderpriority = '3-MEDIUM'), 6) as \"3-MEDIUM\" from orders group by 1")
def eval_win_pivot(s, d):
    return evaluate.win_table(T.table(s, d, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("select l_orderkey, l_linenumber, l_returnflag, count(*) over (partition by l_orderkey) as total, round(l_quantity / sum(l_quantity) over (partition by l_orderkey), 6) as share from lineitem")
def eval_group_share(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    return T.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.count("*").over(w).alias("total"), F.round(F.col("l_quantity") / F.sum("l_quantity").over(w), 6).alias("share"))


@query("select least(floor(l_discount / 0.02) * 0.02, 0.06)::double as bin, median(l_extendedprice) as median_price, count(*) as n from lineitem group by 1")
def eval_binned_median(s, d):
    return T.table(s, d, "lineitem").groupBy(evaluate.bins(F.col("l_discount"), 0.02, 0.06).alias("bin")).agg(F.median("l_extendedprice").alias("median_price"), F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, min(l_extendedprice) as lo, max(l_extendedprice) as hi, median(l_quantity) as mid from lineitem group by 1, 2")
def eval_min_max(s, d):
    return T.table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.median("l_quantity").alias("mid"))


@query("select c_nationkey as nation from customer union select s_nationkey from supplier")
def eval_union_distinct(s, d):
    return T.table(s, d, "customer").select(F.col("c_nationkey").alias("nation")).unionByName(T.table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"))).distinct()


@query("select protein, split_part(protein, '.', 1) as stem, split_part(aa1, '-', 1) as seq1, regexp_replace(aa2, '-', '/') as swapped, len(aa1) as size, count(*) as n from labels_ref group by 1, 2, 3, 4, 5")
def eval_string_split(s, d):
    df = T.table(s, d, "labels_ref").select("protein", F.split_part("protein", F.lit("."), F.lit(1)).alias("stem"), F.split_part("aa1", F.lit("-"), F.lit(1)).alias("seq1"), F.expr("concat(substring_index(aa2, '-', 1), '/', substring(aa2, locate('-', aa2) + 1))").alias("swapped"), F.length("aa1").alias("size"))
    return df.groupBy(*df.columns).agg(F.count("*").alias("n"))


@query("select case when sim is null or isnan(sim) then 'none' when sim >= 0.9 then 'high' when sim >= 0.5 then 'middle' else 'low' end as class, count(*) as n from rbh group by 1")
def eval_case_when(s, d):
    sim = F.col("sim")
    kind = F.when(sim.isNull() | F.isnan(sim), "none").when(sim >= 0.9, "high").when(sim >= 0.5, "middle").otherwise("low")
    return T.table(s, d, "rbh").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(f"with {RES}, l as (select fasta, seqnum, count(*) as n from r0 group by 1, 2) select fasta, round(log2(max(n) / min(n)), 6) as log_ratio, max(n) - min(n) as spread from l group by 1")
def eval_length_ratio(s, d):
    n = T.residues(s, d, vectors=False).groupBy("fasta", "seqnum").agg(F.count("*").alias("n"))
    return n.groupBy("fasta").agg(F.round(F.log2(F.max("n") / F.min("n")), 6).alias("log_ratio"), (F.max("n") - F.min("n")).alias("spread"))
