"""Most similar vectors for every vector, by balanced posting lists on two levels.

A bounded sample fixes the cells (hierarchical balanced clustering: a part with many sampled vectors is given many
centroids). Each vector goes to the cell of its nearest centroid (its home) and, near a boundary, to further cells whose
distance is within a ratio of the nearest. Inside a cell, in one task, lists are made of its own rows in the same way:
centroids of a sample, boundary vectors replicated by the ratio of distances, so that the number of lists grows with the
rows and the work a row does not. On both levels centroids are found through an in-memory graph: entry hubs, the graph
neighbourhood of the hub, one hop along the best node's links. A vector is compared with all others of its lists, in
every cell it is in, and what the cells found is put together.

Cells hold about CELL_ROWS rows up to MAX_SAMPLE / 32 x CELL_ROWS = 16 million rows. Beyond that their number stays and
they grow, the lists in them do not; a task then needs about 1 kB a row of its cell (a billion rows: 122,000 rows a cell).

Defined results: rows whose id is null or whose vector is null, of another length, all zero, or holds a null, NaN or
infinity take no part. A repeated id counts once. Copies of a vector are ordinary rows; of a large group of copies
only the smallest ids of each batch travel as vectors, the others follow them and get their result by a join, so no group
of copies meets in one task; in a cell, too, only the smallest ids of the copies are compared. Ties go to the smaller id.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandflow.llm.grid_components import mix
from strandflow.session import cut, small_side

#: Rows sought for a cell and for a list in it; sampled rows per cell, least and most in all.
CELL_ROWS, LIST_ROWS, SAMPLE_PER_CELL, MIN_SAMPLE, MAX_SAMPLE = 2_048, 256, 96, 16_384, 262_144
LINKS, ENTRIES, REPLICAS, RATIO = 16, 1, 4, 0.04
#: The same inside a cell, where replicas are not shuffled, and queries compared at a time.
LIST_REPLICAS, LIST_RATIO, CHUNK = 4, 0.06, 4_096
ASSIGNED = "cell int, id long, lead boolean, home boolean, many boolean, rep long, vec binary"


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).astype(np.float32)


def _lloyd(y: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    c = y[rng.choice(len(y), k, replace=False)]
    for _ in range(rounds):
        at = (y @ c.T).argmax(1)
        order = np.argsort(at, kind="stable")
        used, first = np.unique(at[order], return_index=True)
        c[used] = unit(np.add.reduceat(y[order], first))
    return c, (y @ c.T).argmax(1)


def train_centroids(y: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids for unit vectors y: parts are split until each has its share of the lists."""
    rng, out, todo = np.random.default_rng(seed), [], [(np.arange(len(y)), lists)]
    while todo:
        at, n = todo.pop()
        if n <= 1 or len(at) <= 2:
            out.append(unit(y[at].sum(0, keepdims=True))[0])
            continue
        k = min(n, 24, len(at))
        _, part = _lloyd(y[at], k, 6, rng)
        sizes = np.bincount(part, minlength=k)
        if sizes.max() == len(at):  # one point many times
            out.append(unit(y[at].sum(0, keepdims=True))[0])
            continue
        todo += [(at[part == j], max(1, round(n * sizes[j] / len(at)))) for j in range(k) if sizes[j]]
    return np.stack(out)


class ListIndex:
    """Centroids with a graph over them. links: the nearest other centroids of each; near: per hub, its neighbourhood."""

    def __init__(self, centroids: np.ndarray, y: np.ndarray, seed: int = 7):
        self.c = centroids
        n = len(centroids)
        links = min(LINKS, n - 1)
        self.links = np.zeros((n, links), np.int32)
        for i in range(0, n, 1024) if links else ():
            s = centroids[i : i + 1024] @ centroids.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
            self.links[i : i + 1024] = np.argpartition(-s, links - 1, 1)[:, :links]
        hubs = max(1, min(n, round(math.sqrt(n))))
        self.hubs, at = _lloyd(centroids, hubs, 4, np.random.default_rng(seed))
        cells = [np.flatnonzero(at == h) for h in range(hubs)]
        near = [[m, self.links[m].ravel()] if len(m) else [np.argsort(-(centroids @ self.hubs[h]))[: LINKS + 1]] for h, m in enumerate(cells)]
        # A hub also reaches every centroid that is among the nearest of a sampled vector of the hub.
        top = min(REPLICAS, n)
        for part in np.array_split(y, max(1, len(y) // 4096)):
            hub, best = (part @ self.hubs.T).argmax(1), np.argpartition(-(part @ centroids.T), top - 1, 1)[:, :top]
            for h in np.unique(hub):
                near[h].append(np.unique(best[hub == h]))
        self.near = [np.unique(np.concatenate(x)) for x in near]

    def search(self, x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the nearest centroids, best first; unfilled places have cosine -2."""
        beams, m = min(ENTRIES, len(self.hubs)), min(top, len(self.c))
        ids, sims = np.zeros((len(x), beams, m), np.int32), np.full((len(x), beams, m), -2, np.float32)
        hubs = np.argpartition(-(x @ self.hubs.T), beams - 1, 1)[:, :beams]
        for b in range(beams):
            order = np.argsort(hubs[:, b], kind="stable")
            for g in np.split(order, np.flatnonzero(np.diff(hubs[order, b])) + 1) if len(x) else ():
                near = self.near[hubs[g[0], b]]
                s = x[g] @ self.c[near].T
                p = np.argpartition(-s, min(m, len(near)) - 1, 1)[:, :m]
                ids[g, b, : p.shape[1]], sims[g, b, : p.shape[1]] = near[p], np.take_along_axis(s, p, 1)
        ids, sims = ids.reshape(len(x), -1), sims.reshape(len(x), -1)
        if self.links.shape[1] and len(x):
            more = self.links[np.take_along_axis(ids, sims.argmax(1)[:, None], 1)[:, 0]]
            ids, sims = np.concatenate([ids, more], 1), np.concatenate([sims, np.einsum("nd,nad->na", x, self.c[more])], 1)
        p = np.argsort(ids * np.int64(4) + (sims < -1), 1)
        ids, sims = np.take_along_axis(ids, p, 1), np.take_along_axis(sims, p, 1)
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2
        p = np.argsort(-sims, 1, kind="stable")[:, :top]
        return np.take_along_axis(ids, p, 1), np.take_along_axis(sims, p, 1)

    def lists(self, x: np.ndarray, replicas: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the nearest lists and which of them take the vector, by the ratio of distances."""
        ids, sims = self.search(x, min(replicas, len(self.c)))
        far = np.sqrt(np.maximum(2 - 2 * sims, 0))
        return ids, (sims > -2) & (far <= far[:, :1] * (1 + ratio) + 1e-6)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column, all of length dim, as a matrix; nulls become NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def to_bytes(x: np.ndarray) -> np.ndarray:
    """Stored values without loss in the least width that holds a whole batch: half, single or double floats."""
    for kind in (np.float16, np.float32):
        with np.errstate(over="ignore"):
            if (small := x.astype(kind)).astype(x.dtype).tobytes() == x.tobytes():
                return small
    return x


def binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)), pa.py_buffer(x)])


def from_binary(column: pa.Array, dim: int) -> np.ndarray:
    """The inverse of binary(); rows may differ in width. Double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4) if n else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] else np.zeros(0, np.uint8)
    out, width = np.empty((n, dim)), np.diff(offsets)
    for size, kind in ((2, np.float16), (4, np.float32), (8, np.float64)):
        at = np.flatnonzero(width == size * dim)
        if len(at) == n:
            return data[offsets[0] : offsets[n]].view(kind).reshape(n, dim).astype(np.float64)
        for i in at:
            out[i] = data[offsets[i] : offsets[i + 1]].view(kind)
    return out


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vec of the rows with an id."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter("id is not null")


def with_vectors(df: DataFrame, dim: int) -> DataFrame:
    """Rows of usable() whose vector has dim values; the values themselves are looked at in the tasks."""
    return df.filter(F.size("vec") == dim)


def good_rows(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x).all(1) & (x != 0).any(1)


def fit(df: DataFrame, dim: int, cell_rows: int = CELL_ROWS, seed: int = 7) -> ListIndex | None:
    """The cells of df(id, vec), from a sample of about SAMPLE_PER_CELL rows a cell, at most about MAX_SAMPLE; every row is indexed later."""
    n = df.select("id").count()
    cells = max(1, min(MAX_SAMPLE // 32, n // cell_rows))
    want = min(MAX_SAMPLE, max(MIN_SAMPLE, SAMPLE_PER_CELL * cells))
    picked = df if want >= n else df.filter(F.rand(seed) < want / n)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(g := good_rows(x))), binary(to_bytes(x[g]))], ["id", "vec"])

    table = with_vectors(picked, dim).mapInArrow(packed, "id long, vec binary").toArrow().sort_by("id")
    if not table.num_rows:
        return None
    y = unit(from_binary(table["vec"], dim))
    return ListIndex(train_centroids(y, cells, seed), y[np.random.default_rng(seed).permutation(len(y))], seed)


def first_copies(x: np.ndarray) -> np.ndarray:
    """For each row of x the place of the first row with the same bytes."""
    bits = np.ascontiguousarray(x).view(f"u{x.itemsize}").astype(np.uint64)
    _, first, group = np.unique((bits * mix(np.arange(x.shape[1]))).sum(1), return_index=True, return_inverse=True)
    at = first[group]
    alone = (bits != bits[at]).any(1)
    at[alone] = np.flatnonzero(alone)
    return at


def beyond(copies: int, first: np.ndarray) -> np.ndarray:
    """Which rows are not among the `copies` first ones of their copies (first as first_copies gives it)."""
    order = np.argsort(first, kind="stable")
    start = np.r_[True, np.diff(first[order]) != 0] if len(order) else np.zeros(0, bool)
    place = np.arange(len(order))
    out = np.zeros(len(first), bool)
    out[order] = place - np.maximum.accumulate(np.where(start, place, 0)) >= copies
    return out


def assign(df: DataFrame, index: ListIndex, dim: int, copies: int, replicas: int = REPLICAS, ratio: float = RATIO) -> DataFrame:
    """Rows of ASSIGNED, one for each cell of a vector (many: more than one).

    Of more than `copies` copies in a batch the later ids follow the first (rep; that one is a lead), in cells below 0.
    """
    shared = df.sparkSession.sparkContext.broadcast(index)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            good = np.flatnonzero(good_rows(x))
            if not len(good):
                continue
            _, once = np.unique(ids[good], return_index=True)  # sorted by id
            good = good[once]
            x, ids = x[good], ids[good]
            first = first_copies(x)
            late = beyond(copies, first)
            lead = np.zeros(len(ids), bool)
            lead[first[late]] = True
            keep = np.flatnonzero(~late)
            cells, take = shared.value.lists(unit(x[keep].astype(np.float64)), replicas, ratio)
            row, place = np.nonzero(take)
            many = take.sum(1) > 1
            yield _assigned(cells[row, place], ids[keep][row], lead[keep][row], place == 0, many[row], np.full(len(row), -1), binary(to_bytes(x[keep])[row]))
            if late.any():
                f = ids[late]
                no = np.zeros(len(f), bool)
                yield _assigned(-1 - f % 4096, f, no, no, no, ids[first[late]], pa.nulls(len(f), pa.binary()))

    return with_vectors(df, dim).mapInArrow(put, ASSIGNED)


def _assigned(cells: np.ndarray, ids: np.ndarray, lead: np.ndarray, home: np.ndarray, many: np.ndarray, rep: np.ndarray, vec: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(ids.astype(np.int64)), pa.array(lead), pa.array(home), pa.array(many), pa.array(rep.astype(np.int64)), vec], ["cell", "id", "lead", "home", "many", "rep", "vec"])


class Cell:
    """One cell in a task, its rows in order of id, each once.

    Rows compared are ids with unit vectors x (double) and y (single); of copies beyond `copies`, echo has the ids, of the
    place of the first copy. w: the ids a compared row stands for, itself and its echoes.
    """

    def __init__(self, table: pa.Table, dim: int, copies: int, list_rows: int = LIST_ROWS):
        ids, lead, home, many = (table[c].to_numpy() for c in ("id", "lead", "home", "many"))
        order = np.lexsort((~lead, ids))
        order = order[np.r_[True, np.diff(ids[order]) > 0]] if len(order) else order
        x = from_binary(table["vec"], dim)[order]
        first = first_copies(x)
        late = beyond(copies, first)
        place = np.cumsum(~late) - 1
        self.echo, self.of, self.echo_lead = ids[order][late], place[first[late]], lead[order][late]
        self.ids, self.lead, self.home, self.many = (v[order][~late] for v in (ids, lead, home, many))
        self.w = 1 + np.bincount(self.of, minlength=len(self.ids)).astype(np.int64)
        self.x = x[~late]
        self.x /= np.sqrt((self.x * self.x).sum(1, keepdims=True))
        self.y = self.x.astype(np.float32)
        n = len(self.ids)
        lists = max(1, round(n / list_rows))
        some = self.y[np.random.default_rng(7).permutation(n)[: max(64 * lists, 1024)]]
        index = ListIndex(train_centroids(some, lists), some) if lists > 1 else None
        self.lists, self.take = index.lists(self.y, LIST_REPLICAS, LIST_RATIO) if index else (np.zeros((n, 1), np.int32), np.ones((n, 1), bool))
        row, at = np.nonzero(self.take)
        of = self.lists[row, at]
        by = np.argsort(of, kind="stable")
        self.members, self.start = row[by], np.searchsorted(of[by], np.arange(int(of.max(initial=0)) + 2))

    def pairs(self, min_cos: float, rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For slices of the rows (all, if none are given): row and every row of its lists whose cosine, rounded to 6, is at least min_cos; itself as well."""
        n = len(self.ids)
        rows = np.arange(n) if rows is None else rows
        rows = rows[np.argsort(self.lists[rows, 0], kind="stable")]
        for i in range(0, len(rows), CHUNK):
            part = rows[i : i + CHUNK]
            q, at = np.nonzero(self.take[part])
            of = self.lists[part[q], at]
            order = np.argsort(of, kind="stable")
            q, of = part[q[order]], of[order]
            sure, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g in np.split(np.arange(len(q)), np.flatnonzero(np.diff(of)) + 1) if len(q) else ():
                t = self.members[self.start[of[g[0]]] : self.start[of[g[0]] + 1]]
                for j in range(0, len(g), 512):
                    a = q[g[j : j + 512]]
                    s = self.y[a] @ self.y[t].T
                    r, c = np.nonzero(s >= min_cos - 1e-5)
                    code, ok = a[r] * np.int64(n) + t[c], s[r, c] >= min_cos + 1e-5
                    sure.append(code[ok])
                    near.append(code[~ok])
            close = np.unique(np.concatenate(near))
            close = close[np.round(self.cosines(close // n, close % n), 6) >= min_cos]
            code = np.unique(np.concatenate([*sure, close]))
            yield code // n, code % n

    def cosines(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.concatenate([np.einsum("nd,nd->n", self.x[q[i : i + 65_536]], self.x[t[i : i + 65_536]]) for i in range(0, len(q), 65_536)]) if len(q) else np.zeros(0)


def starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Places where a new key begins."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, int)


FOUND = "id long, other long, cos double, many boolean, lead boolean, rep long"


def _nearest(cell: Cell, k: int, min_cos: float) -> pa.Table:
    """Rows of FOUND: of each row of the cell its k most similar rows here."""
    parts = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for q, t in cell.pairs(min_cos):
        q, t = q[q != t], t[q != t]
        cos = np.round(cell.cosines(q, t), 6)
        order = np.lexsort((t, -cos, q))
        q, t, cos = q[order], t[order], cos[order]
        start = starts(q)
        best = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < k
        parts.append((q[best], t[best], cos[best]))
    q, t, cos = (np.concatenate(p) for p in zip(*parts))
    # An echo has the neighbours of the first copy, and that one itself.
    of, back = np.unique(cell.of, return_inverse=True)
    others, near = np.full((len(of), k + 1), np.iinfo(np.int64).max), np.full((len(of), k + 1), -2.0)
    others[:, k], near[:, k] = cell.ids[of], 1.0
    at = np.flatnonzero(np.isin(q, of))
    row, start = np.searchsorted(of, q[at]), starts(q[at])
    place = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
    others[row, place], near[row, place] = cell.ids[t[at]], cos[at]
    order = np.lexsort((others, -near), axis=1)[:, :k]
    e_other, e_cos = (np.take_along_axis(v, order, 1)[back].ravel() for v in (others, near))
    found = e_cos > -2
    e_id, e_many, e_lead = (np.repeat(v, k)[found] for v in (cell.echo, cell.many[cell.of], cell.echo_lead))
    return pa.table({
        "id": np.concatenate([cell.ids[q], e_id]), "other": np.concatenate([cell.ids[t], e_other[found]]), "cos": np.concatenate([cos, e_cos[found]]),
        "many": np.concatenate([cell.many[q], e_many]), "lead": np.concatenate([cell.lead[q], e_lead]), "rep": pa.nulls(len(q) + len(e_id), pa.int64()),
    })


def similar_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int = 48, k: int = 3, min_cos: float = 0.90, cell_rows: int = CELL_ROWS, **how) -> DataFrame:
    """id, other, cos (double, rounded to 6): for every usable vector its k most similar others with cos >= min_cos."""
    base = usable(df, id_col, vec_col)
    index = fit(base, dim, cell_rows)
    if index is None:
        return df.sparkSession.createDataFrame([], "id long, other long, cos double")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # followers: they take the result of the first copy
            n = table.num_rows
            return pa.table({"id": table["id"], "other": pa.nulls(n, pa.int64()), "cos": pa.nulls(n, pa.float64()), "many": pa.nulls(n, pa.bool_()), "lead": pa.nulls(n, pa.bool_()), "rep": table["rep"]})
        return _nearest(Cell(table, dim, k + 1), k, min_cos)

    found = cut(assign(base, index, dim, k + 1, **how).groupBy("cell").applyInArrow(search, FOUND))
    best = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    top = lambda rows: rows.withColumn("n", F.dense_rank().over(best)).filter(F.col("n") <= k).select("id", "other", "cos").distinct()
    own = found.filter("rep is null and not many").select("id", "other", "cos").unionByName(top(found.filter("rep is null and many").select("id", "other", "cos")))
    follows = found.filter("rep is not null").select("id", "rep")
    if follows.isEmpty():
        return own
    # A row that follows in one batch and is delivered again in another one has its own result.
    rows = found.filter("rep is null")
    follows = cut(follows.groupBy("id").agg(F.min("rep").alias("rep")))
    again = rows.select("id").join(small_side(follows.select("id")), "id", "left_semi").distinct()
    follows = follows.join(small_side(again), "id", "left_anti")
    leads = small_side(rows.filter("lead").select("id").distinct())
    of_lead = top(rows.select("id", "other", "cos").join(leads, "id", "left_semi")).withColumnRenamed("id", "rep")
    of_lead = of_lead.unionByName(leads.select(F.col("id").alias("rep"), F.col("id").alias("other"), F.lit(1.0).alias("cos")))
    return own.unionByName(top(follows.join(of_lead, "rep").select("id", "other", "cos")))


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, **how) -> DataFrame:
    """id1 < id2: pairs of which at least one has the other among its k most similar."""
    return similar_vectors(df, id_col, vec_col, **how).select(F.least("id", "other").alias("id1"), F.greatest("id", "other").alias("id2")).distinct()
