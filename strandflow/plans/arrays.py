"""The alignment of many files at once as arrays in a task: what align() does by joins, step for step.

Rows are the residues of the files of a task, in the order of (file, seqnum, seqpos). Pairs of similar residues are made
once; searches inside gaps only choose among them. Every decision is a file's own: which files go on filling, and whether the
alignment without stranded columns is the more complete one.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators import chains, hits, order, parts
from strandflow.operators.ranks import starts
from strandflow.session import cut, small_side

#: Pairs of residues that a task holds; a file with more of them is left to joins. Rows of a task of many files.
PAIRS, TASK_ROWS = 4_000_000, 20_000
#: Residues of a file up to which a task merges the alignments of its groups.
MERGED = 300_000
PLACED = "file string, seqnum int, seqpos int, clustid long, col long"


class TooLarge(Exception):
    """The files hold more than a task can."""


@dataclass
class Rules:
    minscore: float
    gap_score: float
    most: int
    chain: str | None
    reciprocal: bool
    brokers: float | None


def similar(idx: np.ndarray, seq: np.ndarray, x: np.ndarray, minscore: float, side: np.ndarray | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places a, b (seq of a below that of b) and similarities of all pairs of one file from minscore up, with side only those of its two values.

    Raises TooLarge beyond `most` pairs.
    """
    most = PAIRS if most is None else most
    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    by = np.lexsort((idx, seq))
    one, two = (by, by) if side is None else (by[side[by] == v] for v in (side.min(), side.max()))
    found, held = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))], 0
    for a, b, _ in hits._near(x.astype(np.float32), seq, one, two, 1, True, minscore, False):
        a, b = one[a], two[b]
        if side is None:
            once = seq[a] < seq[b]
            a, b = a[once], b[once]
        if held + len(a) > 2 * most:
            raise TooLarge
        sim = np.round(hits._cosines(x, a, b), 6)
        ok = sim >= minscore
        a, b = a[ok], b[ok]
        turned = seq[a] > seq[b]
        held += len(a)
        if held > most:
            raise TooLarge
        found.append((np.where(turned, b, a), np.where(turned, a, b), sim[ok]))
    return tuple(np.concatenate(e) for e in zip(*found))


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in any key."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest vertex of the part of each of n vertices."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (higher := root[root] != root).any():
            root[higher] = root[root[higher]]


class Files:
    """Residues (file, seq: dense over the files, pos, idx) of some files, in order, with the pairs a, b of the sought ones and their similarities.

    A column has the label of its smallest residue: the place of its idx among all. at[row] is the label of the row's column, -1 for none.
    """

    def __init__(self, file: np.ndarray, seq: np.ndarray, pos: np.ndarray, idx: np.ndarray, a: np.ndarray, b: np.ndarray, sim: np.ndarray):
        self.n, self.file, self.seq, self.pos, self.idx = len(file), file, seq, pos, idx
        self.files = int(file.max()) + 1 if len(file) else 0
        self.ids = np.sort(idx)
        self.label = np.searchsorted(self.ids, idx)
        self.row = np.argsort(self.label)
        whole = np.rint(sim * 1e6)
        q, t, micro = (np.concatenate(e).astype(np.int32) for e in ((a, b), (b, a), (whole, whole)))
        by = np.lexsort((self.label[t].astype(np.int32), -micro, seq[t].astype(np.int32), q)).astype(np.int32)
        back = np.empty(len(by), np.int32)
        back[by] = np.arange(len(by), dtype=np.int32)
        self.turned = back[(by + len(a)) % max(1, len(by))]
        self.q, self.t, self.micro = q[by], t[by], micro[by]
        self.sim = self.micro / 1e6
        self.best = _firsts(self.q, seq[self.t])

    def hits(self, rules: Rules) -> np.ndarray:
        """Places of the pairs that the first columns are made of."""
        found = self.best & (self.sim >= rules.minscore)
        if rules.reciprocal:
            found = found & found[self.turned] & (self.seq[self.q] < self.seq[self.t])
        i = np.flatnonzero(found)
        if rules.chain:
            q, t = self.q[i], self.t[i]
            i = i[chains.rows_by_pair(self.seq[q], self.pos[q], self.seq[t], self.pos[t], self.sim[i], chains.KEEP[rules.chain])]
        return i

    def _one_each(self, rows: np.ndarray, column: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Places of the best residue of each sequence in a column, then the one of the smallest position."""
        by = np.lexsort((self.pos[rows], -score, self.seq[rows], column))
        return by[_firsts(column[by], self.seq[rows][by])]

    def _several(self, at: np.ndarray) -> np.ndarray:
        """at without columns of one member."""
        size = np.bincount(at[at >= 0], minlength=self.n)
        return np.where((at >= 0) & (size[at] > 1), at, -1)

    def joined(self, i: np.ndarray) -> np.ndarray:
        """at: the parts that the pairs at the places i form, each sequence once, from two members."""
        q, t = self.q[i], self.t[i]
        root = _roots(self.n, self.label[q], self.label[t])
        score = np.zeros(self.n, np.int64)
        np.add.at(score, q, self.micro[i])
        np.add.at(score, t, self.micro[i])
        rows = np.unique(np.concatenate([q, t]))
        keep = rows[self._one_each(rows, root[self.label[rows]], score[rows])]
        at = np.full(self.n, -1)
        at[keep] = root[self.label[keep]]
        return self._several(at)

    def first(self, rules: Rules) -> np.ndarray:
        i = self.hits(rules)
        if rules.brokers is None:
            return self.joined(i)
        at = self._first_pass(self._taken_apart(i[self.sim[i] > 0], rules.brokers), i)
        return self._several(at)

    def _over(self, vertices: np.ndarray) -> bool:
        return len(vertices) > round(1.2 * len(np.unique(self.seq[self.row[vertices]])), 6)

    def _taken_apart(self, i: np.ndarray, cutoff: float, hub: float = 0.2, rounds: int = 25) -> np.ndarray:
        """at: the parts of the pairs at the places i, over-large ones taken apart as doubles.taken_apart() does; the parts go through it one by one."""
        a, b = self.label[self.q[i]], self.label[self.t[i]]
        at, w = np.full(self.n, -1), self.sim[i]
        root = _roots(self.n, a, b)
        used = np.zeros(self.n, bool)
        used[a] = used[b] = True
        v = np.flatnonzero(used)
        at[self.row[v]] = root[v]
        members = np.bincount(root[v], minlength=self.n)
        sequences = np.bincount(np.unique(np.stack([root[v], self.seq[self.row[v]]], 1), axis=0)[:, 0], minlength=self.n) if len(v) else members
        over = members > np.round(1.2 * sequences, 6)
        some = np.flatnonzero(over[root[a]])
        some = some[np.argsort(root[a[some]], kind="stable")]
        todo = deque((e, 0) for e in np.split(some, np.flatnonzero(np.diff(root[a[some]])) + 1) if len(e))
        at[self.row[v[over[root[v]]]]] = -1

        def pieces(e: np.ndarray):
            """The edges, vertices, places in them of both ends, and weights, of each part of the edges e; parallel edges are one."""
            ids, ends = np.unique(np.concatenate([a[e], b[e]]), return_inverse=True)
            mine, other = ends[: len(e)], ends[len(e) :]
            r = _roots(len(ids), mine, other)
            for c in np.unique(r):
                of = np.flatnonzero(r[mine] == c)
                ids_c, ends_c = np.unique(np.concatenate([a[e[of]], b[e[of]]]), return_inverse=True)
                n = len(ids_c)
                if n > parts.LIMIT:
                    raise TooLarge
                m, o = ends_c[: len(of)], ends_c[len(of) :]
                key, where = np.unique(np.minimum(m, o) * n + np.maximum(m, o), return_inverse=True)
                yield e[of], ids_c, m, o, (n, key // n, key % n, np.bincount(where, w[e[of]]))

        def sorted_out(edges: list[np.ndarray], small: int = 0) -> list[np.ndarray]:
            """What is still over-large; the other parts are columns."""
            left = []
            for e in edges:
                for own, ids, *_ in pieces(e) if len(e) else ():
                    if self._over(ids) and len(ids) > small:
                        left.append(own)
                    else:
                        at[self.row[ids]] = ids[0]
            return left

        while todo:
            begun, depth = todo.popleft()
            if depth == rounds:
                raise RuntimeError(f"over-large columns are left after {rounds} rounds")
            edges = []
            for own, _, m, o, graph in pieces(begun):
                keep = parts.between(*graph)["betweenness"] < cutoff if graph[0] > 5 else np.ones(graph[0], bool)
                edges.append(own[keep[m] & keep[o]])
            left, edges = sorted_out(edges, 5), []
            for e in left:
                strong = parts.hubs(*next(pieces(e))[4])["hub"] > hub
                _, _, m, o, _ = next(pieces(e))
                keep = strong[m] & strong[o]
                edges.append(e[keep] if keep.any() else e)
            left, edges = sorted_out(edges), []
            for e in left:
                _, _, m, o, graph = next(pieces(e))
                group = parts.walks(3)(*graph)["community"]
                edges.append(e[group[m] == group[o]])
            if sum(map(len, edges)) == len(begun):
                for _, ids, *_ in pieces(begun):
                    at[self.row[ids]] = ids[0]
            else:
                todo.extend((e, depth + 1) for e in sorted_out(edges))
        return at

    def _first_pass(self, at: np.ndarray, i: np.ndarray, most: int = 5) -> np.ndarray:
        """at without doubles: decided by the columns next to them, then by strength in the column, as doubles.first_pass() does."""
        follows = ~_firsts(self.seq) & (np.diff(self.pos, prepend=0) == 1)
        before, after = np.full(self.n, -1), np.full(self.n, -1)
        after[:-1] = np.where(follows[1:], at[1:], -1)
        before[1:] = np.where(follows[1:], at[:-1], -1)
        rows = np.flatnonzero(at >= 0)
        _, pair, times = np.unique(np.stack([at[rows], self.seq[rows]], 1), axis=0, return_inverse=True, return_counts=True)
        pair = pair.ravel()
        twice = times[pair] > 1
        if twice.any():
            single, double, pair = rows[~twice], rows[twice], pair[twice]
            kinds, said = [], []
            for own in (before, after):
                has = single[own[single] >= 0]
                known = np.unique(at[has] * self.n + own[has])
                inside = (own[double] >= 0) & np.isin(at[double] * self.n + own[double], known)
                kinds.append(np.bincount(known // self.n, minlength=self.n)[at[double]] + ((own[double] >= 0) & ~inside))
                said.append(np.bincount(at[has], minlength=self.n)[at[double]] + inside)
            least = np.minimum(*kinds)
            lowest = np.full(len(times), 1 << 60)
            np.minimum.at(lowest, pair, np.maximum(least, 1))
            i_ = lowest[pair]
            support = np.where((i_ <= most) & (least <= i_), sum(np.where(k <= i_, s, 0) for k, s in zip(kinds, said)), -1)
            top = np.full(len(times), -1)
            np.maximum.at(top, pair, support)
            leads = (support >= 0) & (support == top[pair])
            alone = np.bincount(pair[leads], minlength=len(times))[pair] == 1
            at = at.copy()
            at[double[alone & ~leads]] = -1
        q, t = self.q[i], self.t[i]
        inner = (at[q] >= 0) & (at[q] == at[t])
        score = np.zeros(self.n, np.int64)
        np.add.at(score, q[inner], self.micro[i][inner])
        np.add.at(score, t[inner], self.micro[i][inner])
        rows = np.flatnonzero(at >= 0)
        keep = rows[self._one_each(rows, at[rows], score[rows])]
        out = np.full(self.n, -1)
        out[keep] = at[keep]
        return out

    def _arcs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.flatnonzero(at >= 0)
        c1, c2 = at[rows][:-1], at[rows][1:]
        on = (self.seq[rows][:-1] == self.seq[rows][1:]) & (c1 != c2)
        key, weight = np.unique(c1[on] * self.n + c2[on], return_counts=True)
        return key // max(1, self.n), key % max(1, self.n), weight

    def columns(self, at: np.ndarray) -> tuple[np.ndarray, bool]:
        """By label the places of the columns of at, each file's from 0 (-1: no column), and whether some are on a cycle."""
        rows = np.flatnonzero(at >= 0)
        size = np.bincount(at[rows], minlength=self.n)
        x = np.round(np.bincount(at[rows], self.pos[rows], minlength=self.n) / np.maximum(size, 1), 9)
        c1, c2, _ = self._arcs(at)
        ids, found, part = order.leveled(c1, c2, x[c1], x[c2])
        level = np.zeros(self.n, np.int64)
        level[ids] = found
        return self._numbered(np.flatnonzero(size), level), bool((part >= 0).any())

    def _numbered(self, ids: np.ndarray, level: np.ndarray) -> np.ndarray:
        file = self.file[self.row[ids]]
        by = np.lexsort((ids, level[ids], file))
        col = np.full(self.n, -1)
        start = np.searchsorted(file[by], np.arange(self.files))
        col[ids[by]] = np.arange(len(by)) - start[file[by]]
        return col

    def consistent(self, at: np.ndarray, col: np.ndarray) -> np.ndarray:
        """at without the members that step back: each sequence keeps its heaviest increasing chain of columns."""
        rows = np.flatnonzero(at >= 0)
        seq, c = self.seq[rows], col[at[rows]]
        back = (seq[1:] == seq[:-1]) & (c[1:] <= c[:-1])
        size = np.bincount(at[rows], minlength=self.n).astype(float)
        at = at.copy()
        for s in np.unique(seq[1:][back]):
            own = rows[np.searchsorted(seq, s) : np.searchsorted(seq, s, "right")]
            keep = chains.heaviest_chain(self.pos[own], col[at[own]], size[at[own]])
            at[np.delete(own, keep)] = -1
        return at

    def settle(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """at made consistent with the order of its columns, and their places (not numbered anew); columns left with one member go."""
        col, cyclic = self.columns(at)
        if cyclic:
            c1, c2, w = self._arcs(at)
            power = np.bincount(c1, w, minlength=self.n) + np.bincount(c2, w, minlength=self.n)
            back = col[c1] > col[c2]
            c1, c2 = c1[back], c2[back]
            weak = np.concatenate([c2[power[c1] >= 2 * power[c2]], c1[(power[c1] < 2 * power[c2]) & (power[c2] >= 2 * power[c1])]])
            gone = np.zeros(self.n, bool)
            gone[weak] = True
            at = self.consistent(np.where((at >= 0) & ~gone[at], at, -1), col)
        return self._several(at), col

    def _open(self, at: np.ndarray, col: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows without a column in files with columns, and the places of the columns before and after (one beyond the ends of the file)."""
        some, here = at >= 0, np.arange(self.n)
        before = np.maximum.accumulate(np.where(some, here, -1))
        after = np.minimum.accumulate(np.where(some, here, self.n)[::-1])[::-1]
        rows = np.flatnonzero(~some & (last[self.file] >= 0))
        p, x = before[rows], after[rows]
        has_p = (p >= 0) & (self.seq[p] == self.seq[rows])
        x_ = np.minimum(x, self.n - 1)
        has_x = (x < self.n) & (self.seq[x_] == self.seq[rows])
        return rows, np.where(has_p, col[at[p]], first[self.file[rows]] - 1), np.where(has_x, col[at[x_]], last[self.file[rows]] + 1)

    def _inside(self, at: np.ndarray, col: np.ndarray) -> np.ndarray:
        """New columns of reciprocal best hits inside the islands, gaps that lie over a common column."""
        first, last = self._ends(at, col)
        rows, a, b = self._open(at, col, first, last)
        wide = np.where(last >= 0, last + 3, 0)
        off = np.cumsum(wide) - wide + 1
        a, b = a + off[self.file[rows]], b + off[self.file[rows]]
        over = np.zeros(int(wide.sum()) + 2, np.int64)
        np.add.at(over, a + 1, 1)
        np.add.at(over, b, -1)
        island = np.cumsum(np.cumsum(over) <= 0)
        of = np.full(self.n, -1)
        of[rows] = island[a]
        i = np.flatnonzero((of[self.q] >= 0) & (of[self.q] == of[self.t]))
        top = np.zeros(len(self.q), bool)
        top[i[_firsts(self.q[i], self.seq[self.t[i]])]] = True
        return self.joined(np.flatnonzero(top & top[self.turned] & (self.seq[self.q] < self.seq[self.t])))

    def _ends(self, at: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(at >= 0)
        first, last = np.full(self.files, 1 << 60), np.full(self.files, -1)
        np.minimum.at(first, self.file[rows], col[at[rows]])
        np.maximum.at(last, self.file[rows], col[at[rows]])
        return first, last

    def _fitting(self, at: np.ndarray, col: np.ndarray, least: float) -> np.ndarray:
        """Open rows with the column strictly between their flanks of the greatest mean similarity above least."""
        rows, a, b = self._open(at, col, *self._ends(at, col))
        low, high = np.full(self.n, 1 << 60), np.full(self.n, -1)
        low[rows], high[rows] = a, b
        i = np.flatnonzero(self.best & (at[self.t] >= 0) & (high[self.q] >= 0))
        q, c = self.q[i].astype(np.int64), at[self.t[i]]
        fits = (low[q] < col[c]) & (col[c] < high[q])
        q, c, s = q[fits], c[fits], self.micro[i][fits]
        key, where = np.unique(q * self.n + c, return_inverse=True)
        total, count = np.zeros(len(key), np.int64), np.bincount(where, minlength=len(key))
        np.add.at(total, where, s)
        score = np.sign(total) * ((2 * np.abs(total) + count) // (2 * np.maximum(count, 1)))
        ok = score / 1e6 > least
        q, c, score = key[ok] // self.n, key[ok] % self.n, score[ok]
        by = np.lexsort((c, -score, q))
        by = by[_firsts(q[by])]
        q, c, score = q[by], c[by], score[by]
        keep = self._one_each(q, c, score)
        new = np.full(self.n, -1)
        new[q[keep]] = c[keep]
        return new

    def _per_file(self, at: np.ndarray) -> np.ndarray:
        return np.bincount(self.file[at >= 0], minlength=self.files)

    def fill(self, at: np.ndarray, col: np.ndarray, rules: Rules) -> np.ndarray:
        """at after passes of both phases, new columns inside gaps and the best column of a residue, until no file gains a residue."""
        done = np.full(self.n, -1)
        for _ in range(rules.most):
            before = self._per_file(at)
            for phase in ("inside", "best"):
                new = self._inside(at, col) if phase == "inside" else self._fitting(at, col, rules.gap_score)
                changed = self._per_file(new) > 0
                if changed.any():
                    own = changed[self.file]
                    next_at, next_col = self.settle(np.where(own, np.where(at >= 0, at, new), -1))
                    used = np.unique(at[~own & (at >= 0)])
                    next_col[used] = col[used]
                    at, col = np.where(own, next_at, at), next_col
            gains = (self._per_file(at) > before)[self.file]
            done = np.where(gains, done, np.maximum(done, at))
            at = np.where(gains, at, -1)
            if not gains.any():
                return done
        raise RuntimeError(f"files still gain residues after {rules.most} passes")

    def _stranded(self, at: np.ndarray, col: np.ndarray) -> np.ndarray:
        """By label the columns of which some member has neither neighbour of its sequence in the neighbouring column."""
        rows = np.flatnonzero(at >= 0)
        seq, pos, c = self.seq[rows], self.pos[rows], col[at[rows]]
        next_to = (seq[1:] == seq[:-1]) & (pos[1:] == pos[:-1] + 1) & (c[1:] == c[:-1] + 1)
        tied = np.r_[False, next_to] | np.r_[next_to, False] if len(rows) else np.zeros(0, bool)
        loose = np.zeros(self.n, bool)
        loose[at[rows[~tied]]] = True
        return loose

    def squish(self, at: np.ndarray, col: np.ndarray, repeats: int = 20) -> np.ndarray:
        """at with neighbouring columns merged where they share no sequence and each is the other's most similar neighbour."""
        near = np.flatnonzero(self.best & (self.sim > 0))
        for _ in range(repeats):
            i = near[(at[self.q[near]] >= 0) & (at[self.t[near]] >= 0)]
            left, right = at[self.q[i]], at[self.t[i]]
            step = col[right] - col[left]
            i, left, right, step = (e[np.abs(step) == 1] for e in (i, left, right, step))
            low, high = np.where(step > 0, left, right), np.where(step > 0, right, left)
            rows = np.flatnonzero(at >= 0)
            wide = int(col.max(initial=0)) + 2
            key = np.sort(self.seq[rows] * wide + col[at[rows]])
            clash = np.zeros(self.n, bool)
            clash[at[rows[np.isin(self.seq[rows] * wide + col[at[rows]] + 1, key)]]] = True
            weight = np.zeros(self.n, np.int64)
            np.add.at(weight, low, self.micro[i])
            after = np.full(self.n, -1)
            after[low] = high
            c1 = np.flatnonzero((after >= 0) & ~clash)
            v, of = np.concatenate([c1, after[c1]]), np.concatenate([c1, c1])
            by = np.lexsort((col[of], -weight[of], v))
            by = by[_firsts(v[by])]
            both = np.bincount(of[by], minlength=self.n) == 2
            into = np.flatnonzero(both)
            if not len(into):
                break
            to = np.arange(self.n)
            to[after[into]] = into
            at = np.where(at >= 0, to[at], -1)
            gone = np.zeros(self.n, bool)
            gone[after[into]] = True
            col = self._numbered(np.flatnonzero((col >= 0) & ~gone), col)
        return at

    def align(self, rules: Rules) -> np.ndarray:
        """at: the column of every residue that gets one."""
        at, col = self.settle(self.first(rules))
        if not (at >= 0).any():
            return at
        at = self.fill(at, col, rules)
        col = self.columns(at)[0]
        loose = self._stranded(at, col)
        touched = np.zeros(self.files, bool)
        touched[self.file[self.row[loose]]] = True
        if touched.any():  # stranded columns are taken out and filled again; the more complete alignment stays
            again, p = self.settle(np.where((at >= 0) & ~loose[at] & touched[self.file], at, -1))
            again = self.fill(again, p, rules)
            better = (self._per_file(again) > self._per_file(at))[self.file]
            at = np.where(better, again, at)
            col = self.columns(at)[0]
        at = self.squish(at, col)
        return self.consistent(at, self.columns(at)[0])

    def result(self, at: np.ndarray, singles: bool) -> dict[str, np.ndarray]:
        """row, clustid and col (from 0 in every file) of the residues with a column; with singles all have one, of their own where at has none."""
        rows = np.arange(self.n) if singles else np.flatnonzero(at >= 0)
        if not len(rows):
            return {"row": rows, "clustid": rows, "col": rows}
        clustid = np.where(at[rows] >= 0, self.ids[np.maximum(at[rows], 0)], -self.idx[rows] - 2)
        ids, first, column = np.unique(clustid, return_index=True, return_inverse=True)
        x = np.round(np.bincount(column, self.pos[rows]) / np.bincount(column), 9)
        on = (self.seq[rows][1:] == self.seq[rows][:-1]) & (column[1:] != column[:-1])
        key = np.unique(column[:-1][on] * len(ids) + column[1:][on])
        c1, c2 = key // len(ids), key % len(ids)
        found, level, _ = order.leveled(c1, c2, x[c1], x[c2])
        levels = np.zeros(len(ids), np.int64)
        levels[found] = level
        file = self.file[rows[first]]
        by = np.lexsort((np.arange(len(ids)), levels, file))
        col = np.empty(len(ids), np.int64)
        col[by] = np.arange(len(ids)) - np.searchsorted(file[by], np.arange(self.files))[file[by]]
        return {"row": rows, "clustid": clustid, "col": col[column]}


def _vectors(t: pa.Table) -> np.ndarray:
    emb = t["emb"].combine_chunks()
    flat = emb.flatten().to_numpy() if isinstance(emb, pa.Array) else np.concatenate([c.flatten().to_numpy() for c in emb.chunks])
    return flat.reshape(t.num_rows, -1).astype(np.float64)


def _rows(t: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order (file, seqnum, seqpos, idx) of t, and its columns in it; file is numbered in the order of names, names has them."""
    names, file = np.unique(t["file"].to_numpy(), return_inverse=True)
    c = {"file": file, **{n: t[n].to_numpy().astype(np.int64) for n in ("seqnum", "seqpos", "idx")}}
    by = np.lexsort((c["idx"], c["seqpos"], c["seqnum"], file))
    return by, {n: v[by] for n, v in c.items()} | {"names": names}


def _files(c: dict[str, np.ndarray], rows: np.ndarray, a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> Files:
    """Files of the rows (places in c, in order), with pairs of such places."""
    file = np.unique(c["file"][rows], return_inverse=True)[1]
    seq = np.cumsum(_firsts(c["file"][rows], c["seqnum"][rows])) - 1
    return Files(file, seq, c["seqpos"][rows], c["idx"][rows], np.searchsorted(rows, a), np.searchsorted(rows, b), sim)


def _table(c: dict[str, np.ndarray], rows: np.ndarray, found: dict[str, np.ndarray]) -> pa.Table:
    rows = rows[found["row"]]
    return pa.table({"file": pa.array(c["names"][c["file"][rows]], pa.string()), **{n: pa.array(v, t) for n, v, t in (("seqnum", c["seqnum"][rows], pa.int32()), ("seqpos", c["seqpos"][rows], pa.int32()), ("clustid", found["clustid"], pa.int64()), ("col", found["col"], pa.int64()))}})


def _left(names: list[str]) -> pa.Table:
    """A row without a column for each file that is left to joins."""
    none = lambda t: pa.nulls(len(names), t)
    return pa.table({"file": pa.array(names, pa.string()), "seqnum": none(pa.int32()), "seqpos": none(pa.int32()), "clustid": none(pa.int64()), "col": none(pa.int64())})


def _align_many(t: pa.Table, rules: Rules, singles: bool) -> pa.Table:
    """PLACED of the files of t; those that are too large come as _left() gives them."""
    by, c = _rows(t)
    x, known = _vectors(t)[by], (t["seqaa"].to_numpy() != "X")[by]
    out, batch, held = [], [], 0
    bounds = np.searchsorted(c["file"], np.arange(len(c["names"]) + 1))

    def run(batch: list) -> None:
        try:
            rows = np.concatenate([r for r, *_ in batch])
            f = _files(c, rows, *(np.concatenate(e) for e in list(zip(*batch))[1:]))
            out.append(_table(c, rows, f.result(f.align(rules), singles)))
        except TooLarge:
            if len(batch) > 1:
                for one in batch:
                    run([one])
            else:
                out.append(_left([c["names"][c["file"][rows[0]]]]))

    for name, i, j in zip(c["names"], bounds, bounds[1:]):
        own = i + np.flatnonzero(known[i:j]) if name else np.zeros(0, int)  # residues without a file are alone
        try:
            a, b, sim = similar(c["idx"][own], c["seqnum"][own], x[own], rules.gap_score)
        except TooLarge:
            out.append(_left([name]))
            continue
        batch.append((np.arange(i, j), own[a], own[b], sim))
        held += len(a)
        if held > PAIRS // 2:
            run(batch)
            batch, held = [], 0
    if batch:
        run(batch)
    return pa.concat_tables(out)


def _align_one(t: pa.Table, pairs: pa.Table, rules: Rules, singles: bool) -> pa.Table:
    """PLACED of one file whose pairs (a, b: idx) were found before."""
    _, c = _rows(t)
    by = np.argsort(c["idx"])
    a, b = (by[np.searchsorted(c["idx"][by], pairs[n].to_numpy())] for n in ("a", "b"))
    rows = np.arange(t.num_rows)
    try:
        f = _files(c, rows, a, b, pairs["sim"].to_numpy())
        return _table(c, rows, f.result(f.align(rules), singles))
    except TooLarge:
        return _left(list(c["names"]))


def _pairs_of(t: pa.Table, minscore: float) -> pa.Table:
    """file, a, b, sim of a pair of blocks of a file; one row without a where it has more than `most`."""
    idx, seq, side = (t[n].to_numpy() for n in ("idx", "seqnum", "b"))
    same = t["i"][0].as_py() == t["j"][0].as_py()
    a, b, sim = (np.zeros(0, int),) * 3
    try:
        if same or side.min() != side.max():
            a, b, sim = similar(idx, seq, _vectors(t), minscore, None if same else side, t["most"][0].as_py())
    except TooLarge:
        return pa.table({"file": [t["file"][0].as_py()], "a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64()), "sim": pa.nulls(1, pa.float64())})
    return pa.table({"file": t["file"].take(pa.array(np.zeros(len(a), int))), "a": idx[a], "b": idx[b], "sim": np.asarray(sim, float)})


def _pairs(res: DataFrame, sizes: DataFrame, minscore: float, block: int) -> DataFrame:
    """file, a, b, sim of the pairs of similar residues of large files, by pairs of blocks as in hits; a file with too many of them has a row without a."""
    m = sizes.select("file", F.ceil(F.col("n") / block).cast("int").alias("m"))
    m = m.withColumn("most", F.greatest(F.lit(200_000), F.ceil(4 * PAIRS / (F.col("m") * (F.col("m") + 1) / 2))).cast("long"))
    rows = res.filter("seqaa <> 'X' and file <> ''").select("file", "idx", "seqnum", "seqpos", "emb").join(F.broadcast(m), "file")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("seqnum", F.floor(F.col("seqpos") / block)), F.col("m")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumns({"i": F.least("b", "other"), "j": F.greatest("b", "other")}).drop("other", "m", "seqpos")
    return rows.groupBy("file", "i", "j").applyInArrow(lambda t: _pairs_of(t, minscore), "file string, a long, b long, sim double")


def aligned(res: DataFrame, rules: Rules, singles: bool, block: int = hits.BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """PLACED of the files of res (file, seqnum, seqpos, seqaa, idx, emb; file '' for none), and the names (file) of those too large for it (None: none).

    A file of up to `block` residues is searched and aligned in the task that has it; of a larger one the pairs are found by
    pairs of blocks, and a task aligns it from them.
    """
    sizes = cut(res.groupBy("file").agg(F.count("*").alias("n")))
    large = cut(sizes.filter(F.col("n") > block))
    some = not large.isEmpty()
    small = res.join(small_side(large.select("file")), "file", "left_anti") if some else res
    buckets = max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // TASK_ROWS)
    found = small.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(buckets))).repartition(int(buckets), "bucket").groupBy("bucket").applyInArrow(lambda t: _align_many(t, rules, singles), PLACED)
    if some:
        own = res.join(small_side(large.select("file")), "file", "left_semi")
        pairs = cut(_pairs(own, large, rules.gap_score, block))
        counts = cut(large.join(pairs.groupBy("file").agg(F.count("*").alias("pairs"), F.count_if(F.col("a").isNull()).alias("over")), "file", "left"))
        held = counts.filter((F.coalesce("pairs", F.lit(0)) <= PAIRS) & (F.coalesce("over", F.lit(0)) == 0)).select("file")
        of = lambda x: x.join(small_side(held), "file", "left_semi")
        one = of(own.select("file", "seqnum", "seqpos", "idx")).groupBy("file").cogroup(of(pairs).groupBy("file")).applyInArrow(lambda t, p: _align_one(t, p, rules, singles), PLACED)
        none = [F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in PLACED.split(", ")[1:]]
        found = found.unionByName(one).unionByName(counts.join(held, "file", "left_anti").select("file", *none))
    found = cut(found)
    left = cut(found.filter("clustid is null").select("file"))
    return found.filter("clustid is not null"), None if left.isEmpty() else left


def _merge(c: dict[str, np.ndarray], rows: np.ndarray, x: np.ndarray, minscore: float) -> None:
    """Puts the groups' alignments of one file (clustid, col of the places rows in c, x their vectors) into one, as filling.merge_groups() does; sets clustid."""
    groups, grp, size = np.unique(c["grp"][rows], return_inverse=True, return_counts=True)
    rank = np.empty(len(groups), np.int64)
    rank[np.lexsort((groups, -size))] = np.arange(len(groups))
    r, clustid, col = rank[grp], c["clustid"][rows], c["col"][rows]
    while r.max() > 0:
        next_id, next_col = clustid.copy(), col.copy()
        for unit in np.unique(r[r % 2 == 1] // 2):
            own = np.flatnonzero(r // 2 == unit)
            key, first, of, n = np.unique(np.stack([r[own] % 2, col[own]], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
            of = of.ravel()
            mean = np.stack([np.bincount(of, v) for v in x[own].T], 1) / n[:, None]
            side, at, ids = key[:, 0], key[:, 1], clustid[own][first]
            a, b, sim = similar(at * 2 + side, side, mean, minscore, side)
            keep = chains.rows_by_pair(side[a], at[a], side[b], at[b], sim, chains.KEEP["weighted"])
            a, b = a[keep], b[keep]
            # a left column keeps its place; an unmatched right one stands just before the next matched left column
            place, match = at.copy(), np.full(len(at), -1)
            match[b] = at[a]
            right = np.flatnonzero(side == 1)
            nxt = np.minimum.accumulate(np.where(match[right] >= 0, match[right], 1 << 40)[::-1])[::-1]
            place[right] = np.where(match[right] >= 0, match[right], nxt - 1)
            then = np.where((side == 1) & (match < 0), at, -1)
            new = np.unique(np.stack([place, then], 1), axis=0, return_inverse=True)[1].ravel()
            into = np.empty(new.max() + 1, np.int64)
            into[new[::-1]] = ids[::-1]  # left columns come first
            next_id[own], next_col[own] = into[new[of]], new[of]
        clustid, col, r = next_id, next_col, r // 2
    c["clustid"][rows] = clustid


def _merge_many(t: pa.Table, placed: pa.Table, minscore: float, singles: bool) -> pa.Table:
    """PLACED of the files of t after merging the groups of placed (idx, grp, clustid, col); what cannot be held comes as _left() gives it."""
    if not t.num_rows:
        return _left([])
    by, c = _rows(t)
    x = _vectors(t)[by]
    p = {n: placed[n].to_numpy() for n in ("idx", "grp", "clustid", "col")}
    order_ = np.argsort(c["idx"])
    row = order_[np.searchsorted(c["idx"][order_], p["idx"])]
    some = np.zeros(len(by), bool)
    some[row] = True
    for n in ("grp", "clustid", "col"):
        c[n] = np.full(len(by), -1)
        c[n][row] = p[n]
    bounds, out, kept = np.searchsorted(c["file"], np.arange(len(c["names"]) + 1)), [], []
    for name, i, j in zip(c["names"], bounds, bounds[1:]):
        try:
            rows = i + np.flatnonzero(some[i:j])
            if len(rows):
                _merge(c, rows, x[rows], minscore)
            kept.append(np.arange(i, j))
        except TooLarge:
            out.append(_left([name]))
    if kept:
        rows, none = np.concatenate(kept), np.zeros(0, int)
        f = _files(c, rows, none, none, np.zeros(0))
        at = np.where(some[rows], np.searchsorted(f.ids, c["clustid"][rows]), -1)
        out.append(_table(c, rows, f.result(at, singles)))
    return pa.concat_tables(out)


def merged(res: DataFrame, placed: DataFrame, minscore: float, singles: bool, most: int = MERGED) -> tuple[DataFrame, DataFrame | None]:
    """PLACED of res (file, seqnum, seqpos, idx, emb) from the alignments of the groups of its files, placed (seqnum, seqpos, grp, clustid, col), and the
    names of the files that are too large (None: none), which have more than `most` residues or pairs than a task holds."""
    sizes = cut(res.groupBy("file").agg(F.count("*").alias("n")))
    large = cut(sizes.filter(F.col("n") > most).select("file"))
    rows = res.select("file", "seqnum", "seqpos", "idx", "emb")
    rows = rows if large.isEmpty() else rows.join(small_side(large), "file", "left_anti")
    buckets = max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // TASK_ROWS)
    bucket = F.pmod(F.xxhash64("file"), F.lit(buckets))
    of = cut(rows.select("file", "seqnum", "seqpos", "idx").join(placed, ["seqnum", "seqpos"]).select("file", "idx", "grp", "clustid", "col"))
    left, right = (d.withColumn("bucket", bucket).groupBy("bucket") for d in (rows, of))
    found = left.cogroup(right).applyInArrow(lambda t, p: _merge_many(t, p, minscore, singles), PLACED)
    none = [F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in PLACED.split(", ")[1:]]
    found = cut(found.unionByName(large.select("file", *none)))
    out = cut(found.filter("clustid is null").select("file"))
    return found.filter("clustid is not null"), None if out.isEmpty() else out


def numbered(placed: DataFrame) -> DataFrame:
    """placed (file, …, col) with the columns of all files numbered together, in the order of the files; those of a file from 0 or any other number on."""
    width = placed.groupBy("file").agg(F.min("col").alias("low"), (F.max("col") - F.min("col") + 1).alias("n"))
    return placed.join(small_side(cut(starts(width, "file", "n"))), "file").withColumn("col", (F.col("col") - F.col("low") + F.col("start")).cast("int")).drop("low", "n", "start")
