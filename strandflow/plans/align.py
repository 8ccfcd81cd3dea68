"""One call from residue vectors to an alignment: hits, columns, order, rounds of filling, stranded and squished columns, groups."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions import vectors as V
from strandflow.operators import chains, columns, communities, doubles, filling, hits, order, reduce
from strandflow.plans import arrays
from strandflow.session import cut, drop_cut

#: What keeps the hits of a pair from crossing: the heaviest chain, the longest one, or the longest increasing run of targets.
CHAINS = {"weighted": lambda e: chains.chains(e, True), "longest": lambda e: chains.chains(e), "increasing": chains.increasing_hits}


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("q_seq").alias("s1"), F.col("q_pos").alias("p1"), F.col("t_seq").alias("s2"), F.col("t_pos").alias("p2"), "sim")


def _first(found: DataFrame, brokers: float | None) -> DataFrame:
    """seqnum, seqpos, clustid: columns of at least two residues from hits, over-large ones taken apart, each sequence once."""
    if brokers is None:
        return filling.first_columns(found)
    ends = found.select(F.col("q").alias("vertex"), F.col("q_seq").alias("seqnum"), F.col("q_pos").alias("seqpos")).unionByName(found.select(F.col("t").alias("vertex"), F.col("t_seq").alias("seqnum"), F.col("t_pos").alias("seqpos")))
    ends = cut(ends.distinct())
    apart = doubles.taken_apart(found.select(F.col("q").alias("src"), F.col("t").alias("dst"), F.col("sim").alias("w")), ends.select("vertex", "seqnum"), brokers)
    members = cut(apart.join(ends, "vertex").select("clustid", "seqnum", "seqpos"))
    members = cut(doubles.first_pass(members, _edges(found)))
    size = members.groupBy("clustid").agg(F.count("*").alias("n")).filter("n > 1")
    return members.join(size, "clustid", "left_semi").select("seqnum", "seqpos", "clustid")


def _settle(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """placed made consistent with the order of its columns, and that order; columns left with one member go. Without a cycle all of it is consistent."""
    placed = cut(placed)
    leveled = cut(order.levels(placed))
    o, kept = cut(order.column_order(placed, "fasta", leveled)), placed.select("seqnum", "seqpos", "clustid")
    if not leveled.filter("cycle is not null").isEmpty():
        weak = order.weaker_ends(order.feedback_arcs(placed, o), placed)
        kept = order.consistent(placed.join(weak, "clustid", "left_anti"), o)
    size = kept.groupBy("clustid").agg(F.count("*").alias("n")).filter("n > 1")
    kept = cut(kept.join(size, "clustid", "left_semi"))
    return kept, o.join(kept.select("clustid").distinct(), "clustid", "left_semi")


def _filled(placed: DataFrame, o: DataFrame, res: DataFrame, sims: DataFrame, with_file, gap_score: float, most: int) -> tuple[DataFrame, DataFrame]:
    """placed and its order after passes of both phases, new columns inside gaps and the best column of a residue, until no file gains a residue.

    A file that gains none in a pass is done and takes no part in the next ones. Raises where files still gain after `most` passes.
    """
    done = None
    for _ in range(most):
        before = with_file(placed).groupBy("fasta").agg(F.count("*").alias("before"))
        before = cut(before)
        here = res.join(before, "fasta", "left_semi")
        some = False
        for phase in ("inside", "best"):
            spare = filling.open_residues(here, placed, o)
            if phase == "inside":
                new = filling.cluster_islands(filling.gap_islands(spare, placed, o, here), here, gap_score)
            else:
                new = filling.best_columns(spare, placed, o, sims, gap_score).select("seqnum", "seqpos", "clustid")
            new = cut(new)
            if not new.isEmpty():
                some = True
                placed, o = _settle(with_file(placed.unionByName(new)))
        kept = placed
        if some:
            gained = cut(with_file(placed).groupBy("fasta").agg(F.count("*").alias("after")).join(before, "fasta").filter("after > before").select("fasta"))
            some = not gained.isEmpty()
            kept = cut(with_file(placed).join(gained, "fasta", "left_anti").drop("fasta")) if some else placed
        done = kept if done is None else done.unionByName(kept)
        if not some:
            return done, order.column_order(with_file(done), group="fasta")
        placed = cut(with_file(placed).join(gained, "fasta", "left_semi").drop("fasta"))
        o = cut(o.join(placed.select("clustid").distinct(), "clustid", "left_semi"))
    raise RuntimeError(f"files still gain residues after {most} passes")


def sequence_groups(res: DataFrame, threshold: float) -> DataFrame:
    """seqnum, grp: the groups of similar sequences of a file (grp null: put aside), from the mean vectors of their residues."""
    mean = res.groupBy("fasta", "seqnum").agg(F.count("*").alias("seqlen"), F.array(*(F.avg(F.col("emb")[i]) for i in range(len(res.select("emb").first()[0])))).alias("emb"))
    sims = cut(hits.sequence_similarities(cut(mean), threshold).filter(F.col("correctedseqsim") >= threshold))
    groups = communities.sequence_groups(sims.select(F.col("seq1").alias("src"), F.col("seq2").alias("dst"), F.col("correctedseqsim").alias("w")))
    return mean.select("seqnum").join(groups, mean.seqnum == groups.vertex, "left").select("seqnum", F.when(F.col("vertex").isNull(), F.col("seqnum").cast("long")).otherwise(F.col("community")).alias("grp"))


def align(residues: DataFrame, minscore: float = 0.7, gap_score: float = 0.5, most: int = 100, chain: str | None = None, reciprocal: bool = True, brokers: float | None = 0.10, centre: bool = False, batch: bool = False, reference: int | None = None, pca: int | None = None, heads: tuple[list[int], int] | None = None, unit_heads: bool = False, group: float | None = None, exclude: bool = False, fill: bool = True) -> DataFrame:
    """fasta, seqnum, seqpos, clustid, col: the column of every residue with a vector, columns of a file numbered together.

    residues has fasta, seqnum, seqpos, seqaa, idx, emb. minscore holds for the first columns, gap_score for the passes of
    filling, of which there may be `most`; chain keeps only hits of a pair that do not cross ("weighted", "longest" or "increasing"); brokers is
    the betweenness from which vertices of over-large columns are dropped (None: columns are not taken apart); heads (indices,
    width), each of unit length with unit_heads, centre, batch (with reference, a sequence that stays as it is) and pca
    (dimensions) prepare the vectors; group is the similarity from which sequences of a file are aligned in groups that are merged
    in the end, with exclude those put aside from all groups are left out of the result; fill gives the residues left over
    columns of their own. An empty table gives no rows.
    """
    if chain not in (None, *CHAINS):
        raise ValueError(f"chain must be one of {sorted(CHAINS)} or None")
    res = residues.select("fasta", "seqnum", "seqpos", "seqaa", "idx", "emb")
    if heads:
        res = res.withColumn("emb", V.heads(F.col("emb"), *heads, unit=unit_heads))
    if centre:
        res = res.withColumn("emb", V.centre(F.col("emb")))
    if batch:
        res = res.drop("emb").join(reduce.combat(res.select("fasta", "seqnum", "idx", "emb"), reference).select("idx", "emb"), "idx")
    if pca:
        res = res.drop("emb").join(reduce.pca(res.select("idx", "emb"), pca).select("idx", F.col("reduced").alias("emb")), "idx")
    res = cut(res.withColumn("file", F.coalesce(F.concat(F.lit("/"), "fasta"), F.lit(""))))
    rules = arrays.Rules(minscore, gap_score, most, chain, reciprocal, brokers)
    if group is None or res.isEmpty():
        placed = _aligned(res, rules, fill)
    else:
        groups = cut(sequence_groups(res, group))
        if exclude:
            res = cut(res.join(groups.filter("grp is not null"), "seqnum", "left_semi"))
        unit = groups.withColumn("grp", F.coalesce("grp", -F.col("seqnum").cast("long") - 1))
        apart = cut(res.join(unit, "seqnum").withColumn("fasta", F.concat_ws("/", "fasta", "grp")).withColumn("file", F.concat(F.lit("/"), "fasta")).drop("grp"))
        placed = cut(_aligned(apart, rules, False))
        placed = placed.select("seqnum", "seqpos", "clustid", "col").join(unit, "seqnum")
        found, left = arrays.merged(res, placed, gap_score, fill)
        if left is not None:
            rest = cut(res.join(left, "file", "left_semi"))
            with_group = cut(placed.join(rest.select("seqnum", "fasta").distinct(), "seqnum"))
            whole = with_group.select("seqnum", "seqpos", "clustid")
            if not whole.isEmpty():
                whole = filling.merge_groups(with_group.drop("col"), with_group.select("clustid", "col").distinct(), rest, gap_score)[0].select("seqnum", "seqpos", "clustid")
            found = cut(found.unionByName(_ordered(rest, whole, fill)))
        placed = arrays.numbered(found)
    return placed.select(F.when(F.col("file") != "", F.substring("file", 2, 2**31 - 1)).alias("fasta"), "seqnum", "seqpos", "clustid", "col")


def _ordered(res: DataFrame, placed: DataFrame, fill: bool) -> DataFrame:
    """file, seqnum, seqpos, clustid, col of placed, with fill also of the residues left over."""
    if fill:
        placed = placed.unionByName(filling.singletons(res, placed))
    placed = cut(placed.join(res.select("seqnum", "file").distinct(), "seqnum"))
    return placed.join(order.column_order(placed, group="file"), "clustid").select("file", "seqnum", "seqpos", "clustid", "col")


def _aligned(res: DataFrame, rules: arrays.Rules, fill: bool) -> DataFrame:
    """file, seqnum, seqpos, clustid, col of all files; those that a task cannot hold are aligned by joins."""
    found, left = arrays.aligned(res, rules, fill)
    if left is not None:
        rest = cut(res.join(left, "file", "left_semi"))
        placed = by_joins(rest, rules)[0].select("seqnum", "seqpos", "clustid")
        found = cut(found.unionByName(_ordered(rest, placed, fill)))
    return arrays.numbered(found)


def by_joins(res: DataFrame, rules: arrays.Rules) -> tuple[DataFrame, DataFrame]:
    """seqnum, seqpos, clustid of the residues that get a column, and the order of the columns, of files of any size."""
    minscore, gap_score, most, chain, reciprocal, brokers = astuple(rules)
    files = cut(res.select("seqnum", "fasta").distinct())
    near = cut(hits.neighbours(res.filter("seqaa <> 'X'"), 1, True, gap_score).drop("rank"))
    found = near.filter(F.col("sim") >= minscore)
    found = hits.reciprocal(found) if reciprocal else found
    if chain:
        keep = CHAINS[chain](_edges(found)).drop("sim").distinct()
        keys = ["q_seq", "q_pos", "t_seq", "t_pos"]
        found = found.join(keep.toDF(*keys), keys, "left_semi")
    found = cut(found)
    with_file = lambda p: p.join(files, "seqnum")
    placed, o = _settle(with_file(cut(_first(found, brokers))))
    sims = _edges(near)
    if not placed.isEmpty():
        placed, o = (cut(x) for x in _filled(placed, o, res, sims, with_file, gap_score, most))
        # Stranded columns are taken out and filled again; the more complete alignment stays.
        loose = cut(columns.stranded(placed, o))
        if not loose.isEmpty():
            again, p = _settle(with_file(placed.join(loose, "clustid", "left_anti")))
            again, p = (cut(x) for x in _filled(again, p, res, sims, with_file, gap_score, most)) if not again.isEmpty() else (again, p)
            if again.count() > placed.count():
                placed, o = again, p
        placed = filling.squish(placed, o, sims)
        o = cut(order.column_order(with_file(placed), group="fasta"))
        placed = cut(order.consistent(placed, o))
        o = cut(order.column_order(with_file(placed), group="fasta"))
    drop_cut(near)
    return placed, o
