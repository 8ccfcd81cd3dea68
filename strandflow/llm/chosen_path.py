"""Near-duplicate records with small edits, by a chosen-path join on token sets.

In each of several runs every set starts at the run's root and follows those of its tokens that a hash of (path, token)
selects, about 1 / (threshold x size) of them, so similar sets meet in a bucket with a constant chance however large
the collection is. Buckets of at most LEAF sets are compared outright; larger ones are split again by further tokens.
What is still large at the last level is compared in blocks over many tasks, so nothing is left out. Runs are repeated
until the expected recall of pairs at the threshold, of any sizes and down to the last level, passes 0.99. In a bucket, 128-bit sign sketches put aside pairs whose
sketches differ by more than 3.5 standard deviations beyond what the threshold leads to. Vectors join through sets too: of TABLES random
hyperplane codes of BITS bits, one token each. Every candidate is then checked exactly.

Sets equal in all tokens are one node of the join (`classes`); in a result of pairs, up to EXPAND copies are written out
as all pairs, of a larger class every copy is paired with the smallest id, which alone carries the class's links: no
link between different records is lost.

Defined results: rows with null ids, and null or empty sets, take no part; tokens count once; a repeated id counts
once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.llm import posting_lists as pl
from strandflow.llm.grid_components import mix
from strandflow.session import cut, small_side

#: Sets compared outright; levels; copies written out as pairs; rows of a block of what is large at the last level.
LEAF, LEVELS, EXPAND, BLOCK = 32, 5, 50, 2_048
RECALL, TABLES, BITS, SKETCH = 0.99, 96, 16, 128


def survival(shared: float, levels: int = LEVELS) -> float:
    """Chance that two sets still meet after so many levels, sharing on average `shared` chosen tokens a level (Poisson branching)."""
    chance = 1.0
    for _ in range(levels):
        chance = 1 - math.exp(-shared * chance)
    return chance


def runs_for(recall: float = RECALL, levels: int = LEVELS) -> int:
    """Runs that bring pairs at the threshold to the recall at the last level. Equal-sized ones share 2 / (1 + threshold) chosen
    tokens a level on average, the worst, one set inside the other, share one."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(1.0, levels)))


def bits_apart(cos: float, bits: int = SKETCH, deviations: float = 3.5) -> int:
    """Most differing sketch bits of two vectors of this cosine, but for a chance of about 1 in 4,000."""
    p = math.acos(cos) / math.pi
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def _longs(signs: np.ndarray) -> pa.Array:
    """Rows of SKETCH signs as an array of two longs each."""
    words = np.packbits(signs, axis=1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, words.shape[1], dtype=np.int32)), pa.array(words.ravel()))


def sketched(sets: DataFrame) -> DataFrame:
    """(id, tokens) with a sketch: the signs of sums over the tokens of random +1 / -1 vectors, drawn by hashing the token."""

    def draw(batches):
        for b in batches:
            lists = b.column(1)
            tokens, ends = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().cumsum()
            if not len(tokens):
                continue
            words = np.stack([mix(tokens, i) for i in range(SKETCH // 64)], 1)
            plus = np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32)
            total = np.add.reduceat(plus, np.r_[0, ends[:-1]], axis=0)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, _longs(2 * total > np.diff(np.r_[0, ends])[:, None])], ["id", "tokens", "sketch"])

    return sets.select("id", "tokens").filter("size(tokens) > 0").mapInArrow(draw, "id long, tokens array<long>, sketch array<long>")


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, tokens) -> the classes (id = smallest member, tokens, n) and the membership (member, id)."""
    keyed = sets.filter("id is not null and size(tokens) > 0").select("id", F.array_sort(F.array_distinct("tokens")).alias("tokens")).withColumn("k", F.xxhash64("tokens"))
    nodes = cut(keyed.groupBy("k", "tokens").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    member = keyed.select("k", F.col("id").alias("member")).join(nodes.filter("n > 1").select("k", "id"), "k").filter("member <> id").select("member", "id").distinct()
    return nodes.select("id", "tokens", "n"), member


def candidate_pairs(sets: DataFrame, threshold: float, apart: int, runs: int | None = None, leaf: int = LEAF, levels: int = LEVELS, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """a < b: pairs of ids of sets(id, tokens, sketch) that met in a bucket with sketches at most `apart` bits from each other."""
    runs = runs or runs_for(levels=levels)
    roots = F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("r")
    grown = sets.select("id", "tokens", "sketch", roots).withColumn("path", F.xxhash64(F.lit(seed), "r"))
    alike = sum((F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0)) <= apart
    met, large = None, None
    for level in range(levels):
        step = grown.select("id", "sketch", "path", F.size("tokens").alias("n"), F.explode("tokens").alias("t")).withColumn("h", F.xxhash64("path", "t"))
        chosen = F.pmod(F.col("h"), F.lit(1 << 24)) < F.lit(float(1 << 24)) / (F.lit(threshold) * F.col("n"))
        rows = cut(step.filter(chosen).select("id", "sketch", F.xxhash64("h", F.lit(level)).alias("path")))
        large = cut(rows.groupBy("path").count().filter(F.col("count") > leaf))
        some = not large.isEmpty()
        side = small_side(large)
        small = (rows.join(side, "path", "left_anti") if some else rows).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("id", "sketch"))).alias("in")).filter(F.size("in") > 1)
        pairs = small.select("in", F.posexplode("in").alias("i", "x")).select("x", F.explode(F.expr("slice(in, i + 2, size(in))")).alias("y"))
        pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.sketch").alias("sa"), F.col("y.sketch").alias("sb")).filter((F.col("a") < F.col("b")) & alike).select("a", "b")
        met = pairs if met is None else met.unionByName(pairs)
        if not some:
            return met.distinct()
        heads = rows.join(side, "path", "left_semi")
        grown = heads.join(sets.select("id", "tokens"), "id")
    # Each pair of blocks of what is still large is one group: a row goes to all cells of its row and column.
    blocks = F.ceil(F.col("count") / block).cast("int")
    rows = heads.join(small_side(large.select("path", blocks.alias("m"))), "path").withColumn("b", F.pmod(F.xxhash64("id", "path"), F.col("m")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("path", "id", "sketch", "b", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"))
    rest = cells.groupBy("path", "i", "j").applyInArrow(lambda t: _near_sketches(t, apart), "a long, b long")
    return met.unionByName(rest).distinct()


def _near_sketches(t: pa.Table, apart: int) -> pa.Table:
    """a < b: pairs of ids of two blocks (or of one with itself) whose sketches differ in at most `apart` bits."""
    ids, side = t["id"].to_numpy(), t["b"].to_numpy()
    words = t["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    one, two = np.flatnonzero(side == i), np.flatnonzero(side == j)
    parts = [np.zeros((2, 0), np.int64)]
    for k in range(0, len(one), 512):
        q = one[k : k + 512]
        bits = sum(np.bitwise_count(words[q, w][:, None] ^ words[two, w][None, :]).astype(np.int16) for w in range(words.shape[1]))
        x, y = np.nonzero(bits <= apart)
        x, y = ids[q[x]], ids[two[y]]
        ends = np.stack([np.minimum(x, y), np.maximum(x, y)])[:, x != y]
        parts.append(np.unique(ends, axis=1))
    a, b = np.concatenate(parts, axis=1)
    return pa.table({"a": a, "b": b})


def expand(pairs: DataFrame, nodes: DataFrame, member: DataFrame) -> DataFrame:
    """Pairs of classes (a, b) and their copies as pairs of records, by the rule at the top of the module."""
    few = nodes.filter((F.col("n") > 1) & (F.col("n") <= EXPAND)).select("id")
    all_of = member.join(few, "id").select("id", "member").unionByName(few.select("id", F.col("id").alias("member")))
    x, y = all_of.select(F.col("id").alias("a"), F.col("member").alias("ma")), all_of.select(F.col("id").alias("b"), F.col("member").alias("mb"))
    wide = pairs.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b"))
    inside = all_of.select("id", F.col("member").alias("a")).join(all_of.select("id", F.col("member").alias("b")), "id").filter("a < b").select("a", "b")
    star = member.join(few, "id", "left_anti").select(F.col("id").alias("a"), F.col("member").alias("b"))
    return wide.unionByName(inside).unionByName(star).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """a < b: records whose token sets (id, tokens) have a Jaccard similarity of at least threshold."""
    nodes, member = classes(sets)
    slim = cut(sketched(nodes))
    # Sets of Jaccard similarity s have as 0/1 vectors a cosine of at least 2 s / (1 + s).
    met = cut(candidate_pairs(slim, threshold, bits_apart(2 * threshold / (1 + threshold))))
    both = met.join(slim.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
    both = both.join(slim.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b").filter(F.least(F.size("ta"), F.size("tb")) >= F.lit(threshold) * F.greatest(F.size("ta"), F.size("tb")) - 1e-9)
    common = F.size(F.array_intersect("ta", "tb"))
    close = both.withColumn("i", common).filter(F.col("i") >= F.lit(threshold) * (F.size("ta") + F.size("tb") - F.col("i")) - 1e-9)
    return expand(cut(close.select("a", "b")), nodes, member)


def hyperplane_sets(df: DataFrame, id_col: str, vec_col: str, dim: int, tables: int = TABLES, bits: int = BITS, seed: int = 5) -> DataFrame:
    """id, vec (stored values, binary), tokens, sketch: TABLES codes of BITS signs each, for the usable vectors."""
    kind = np.float32 if df.schema[vec_col].dataType.elementType.simpleString() == "float" else np.float64  # one width, so that equal vectors are equal bytes
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits + SKETCH)).astype(np.float32)

    def code(batches):
        for b in batches:
            x = pl.matrix(b.column(1), dim)
            good = pl.good_rows(x)
            x = x[good]
            signs = pl.unit(x.astype(np.float64)) @ planes > 0
            tokens = np.zeros((len(x), tables), np.int64) + (np.arange(tables) << bits)
            for i in range(bits):
                tokens += signs[:, i * tables : (i + 1) * tables].astype(np.int64) << i
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tokens.size + 1, tables, dtype=np.int32)), pa.array(tokens.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pl.binary(x.astype(kind)), lists, _longs(signs[:, tables * bits :])], ["id", "vec", "tokens", "sketch"])

    once = pl.with_vectors(pl.usable(df, id_col, vec_col), dim)
    return once.mapInArrow(code, "id long, vec binary, tokens array<long>, sketch array<long>").dropDuplicates(["id"])


def similar_by_vector(df: DataFrame, id_col: str, vec_col: str, min_cos: float, dim: int = 48) -> DataFrame:
    """a < b: records whose vectors have a cosine (double, rounded to 6) of at least min_cos. Equal vectors are copies."""
    coded = cut(hyperplane_sets(df, id_col, vec_col, dim))
    nodes = cut(coded.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")))
    member = coded.join(nodes.filter("n > 1").select("vec", F.col("id").alias("first")), "vec").filter("id <> first").select(F.col("id").alias("member"), F.col("first").alias("id"))
    # Share of equal codes at the angle of min_cos, and from it the similarity of the sets.
    equal = (1 - math.acos(min_cos) / math.pi) ** BITS
    met = cut(candidate_pairs(nodes.select("id", "tokens", "sketch"), equal / (2 - equal), bits_apart(min_cos)))

    def near(batches):
        for b in batches:
            x, y = pl.from_binary(b.column(2), dim), pl.from_binary(b.column(3), dim)
            cos = np.einsum("nd,nd->n", x, y) / np.sqrt(np.einsum("nd,nd->n", x, x) * np.einsum("nd,nd->n", y, y))
            ok = pa.array(np.round(cos, 6) >= min_cos)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    va, vb = nodes.select(F.col("id").alias("a"), F.col("vec").alias("va")), nodes.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    close = met.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(near, "a long, b long")
    return expand(cut(close), nodes, member)


def residue_runs(residues: DataFrame, width: int = 3, least: int = 10) -> DataFrame:
    """id (seqnum), tokens: the distinct runs of `width` adjacent residues in order of seqpos; sequences with fewer than `least` are left out.

    A repeated (seqnum, seqpos) counts once; null residues read as X, letters in upper case.
    """
    along = Window.partitionBy("id").orderBy("seqpos")
    one = residues.filter("seqnum is not null and seqpos is not null").select(F.col("seqnum").cast("long").alias("id"), "seqpos", F.upper(F.coalesce("seqaa", F.lit("X"))).alias("aa"))
    one = one.withColumn("before", F.lag("seqpos").over(along)).filter("before is null or before <> seqpos")
    run = F.concat_ws("", "aa", *(F.lead("aa", i).over(along) for i in range(1, width)))
    runs = one.select("id", run.alias("run"), F.lead("aa", width - 1).over(along).alias("last")).filter("last is not null")
    return runs.groupBy("id").agg(F.collect_set(F.xxhash64("run")).alias("tokens")).filter(F.size("tokens") >= least)
