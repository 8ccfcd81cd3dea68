import base64
import itertools

import numpy as np
import pyarrow as pa
import pytest

from strandflow.llm import chosen_path, grid_components, markov, packing, posting_lists, stuffed, tokenizer

VEC = "id long, vec array<float>, list int, w string"


def vectors(spark, groups, copies=0):
    rng, data, n = np.random.default_rng(5), [], 0
    for size in groups:
        c = rng.standard_normal(48)
        for _ in range(size):
            data.append((n, (c + 0.1 * rng.standard_normal(48)).astype(np.float32).tolist(), 1, "x"))
            n += 1
    same = rng.standard_normal(48).astype(np.float32).tolist()
    data += [(n + i, same, 1, "x") for i in range(copies)]
    bad = [(900, None, 1, "x"), (901, [0.0] * 48, 1, "x"), (902, [float("nan")] * 48, 1, "x"), (903, [1.0] * 47, 1, "x"), (None, same, 1, "x"), (904, [None] + [1.0] * 47, 1, "x")]
    return spark.createDataFrame(data + bad + data[:3], VEC), data


def brute(data, k=3):
    x = np.array([d[1] for d in data], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = set()
    for i in range(len(data)):
        order = sorted((j for j in range(len(data)) if j != i and s[i, j] >= 0.9), key=lambda j: (-s[i, j], j))[:k]
        out |= {(min(i, j), max(i, j)) for j in order}
    return out


def test_similar_vectors(spark):
    df, data = vectors(spark, [1, 2, 5, 9, 20], copies=30)
    got = {tuple(r) for r in posting_lists.similar_pairs(df, "id", "vec").collect()}
    assert got == brute(data)
    assert posting_lists.similar_pairs(df.limit(0), "id", "vec").count() == 0


def test_recall_with_many_lists():
    rng = np.random.default_rng(1)
    x = posting_lists.unit(np.repeat(rng.standard_normal((800, 48)), 8, 0) + 0.15 * rng.standard_normal((6400, 48)))
    index = posting_lists.ListIndex(posting_lists.train_centroids(x[::2], 40), x[::2])
    ids, take = index.lists(x, 5, 0.10)
    pairs = [(g * 8 + a, g * 8 + b) for g in range(800) for a, b in itertools.permutations(range(8), 2)]
    q, t = np.array(pairs).T
    assert ((ids[t] == ids[q][:, :1]) & take[t]).any(1).mean() > 0.95


def test_clusters(spark):
    df, data = vectors(spark, [1, 2, 5, 9], copies=12)
    got = markov.clique_clusters(df, "id", "vec").collect()
    sizes = {}
    for r in got:
        sizes[r["clust"]] = sizes.get(r["clust"], 0) + 1
    assert sizes == {3: 5, 8: 9, 17: 12}
    assert sum(r["role"] == "typical" for r in got) == 3
    assert markov.clique_clusters(df.limit(0), "id", "vec").count() == 0


def test_cluster_over_many_lists(spark, monkeypatch):
    """A ball of rows that never all meet in a list is one cluster, checked in pairs of blocks."""
    monkeypatch.setattr(markov, "BLOCK", 1500)
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 48))
    near = [a + 0.05 * rng.standard_normal(48) for _ in range(6000)] + [b + 0.05 * rng.standard_normal(48) for _ in range(5)]
    df = spark.createDataFrame([(i, x.astype(np.float32).tolist(), 1, "x") for i, x in enumerate(near)], VEC)
    got = markov.clique_clusters(df, "id", "vec", cell_rows=2000).toPandas()
    assert got.groupby("clust").id.count().to_dict() == {0: 6000, 6000: 5}
    x = np.array(near[:6000], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean = np.round((x @ x.sum(0) - 1) / 5999, 6)
    assert got[got.role == "typical"].id.tolist().count(int(mean.argmax())) == 1 and (got.role == "typical").sum() == 2


def test_copies_delivered_again(spark):
    """A row that follows a copy in one batch and comes again in another has one row, and copies count once for the typical member."""
    rng = np.random.default_rng(8)
    c = rng.standard_normal(48)
    same = (c + 0.1 * rng.standard_normal(48)).astype(np.float32).tolist()
    near = [(13 + i, (c + 0.1 * rng.standard_normal(48)).astype(np.float32).tolist(), 1, "x") for i in range(4)]
    data = [(i, same, 1, "x") for i in range(13)]
    df = spark.createDataFrame(data + near, VEC).coalesce(1).union(spark.createDataFrame([data[12], data[3], near[0]], VEC).coalesce(1))
    got = markov.clique_clusters(df, "id", "vec").toPandas()
    assert sorted(got.id) == list(range(17)) and set(got.clust) == {0}
    x = np.array([d[1] for d in data + near], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean = np.round((x @ x.sum(0) - 1) / (len(x) - 1), 6)
    assert got[got.role == "typical"].id.tolist() == [int(mean.argmax())]
    assert {tuple(r) for r in posting_lists.similar_pairs(df, "id", "vec").collect()} == brute(data + near)


def dense_flow(a, inflation=2.0, rounds=60):
    m = a / a.sum(0)
    for _ in range(rounds):
        m = (m @ m) ** inflation
        m /= m.sum(0)
        m[m < markov.PRUNE] = 0
        m /= m.sum(0)
    return m


def test_lumped_flow_is_that_of_all_vertices(spark):
    """Vertices with one neighbourhood, counted by sizes, give the clusters of the dense matrix of all of them."""
    sizes = {0: 4, 4: 1, 5: 3, 8: 2, 10: 6}
    links = [(0, 4), (4, 5), (5, 8), (8, 10)]
    of = [v for v, m in sizes.items() for _ in range(m)]
    n = len(of)
    a = np.array([[float(of[i] == of[j] or (of[i], of[j]) in links or (of[j], of[i]) in links) for j in range(n)] for i in range(n)])
    m = dense_flow(a)
    part = {}
    for j in range(n):
        part.setdefault(tuple(np.flatnonzero(m[:, j] >= 0.7 * m[:, j].max())), set()).add(of[j])
    edges = spark.createDataFrame([(u, v, 1.0) for u, v in links], "src long, dst long, w double")
    got = {}
    for r in markov.markov_clusters(edges, spark.createDataFrame(list(sizes.items()), "id long, m long")).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, part.values())) and len(got) > 1
    with pytest.raises(RuntimeError):
        markov.markov_clusters(edges, rounds=1)


def test_markov_lone_loops(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (7, 7, 1.0), (2, 2, 1.0)], "src long, dst long, w double")
    assert {r["id"]: r["cluster"] for r in markov.markov_clusters(edges).collect()} == {1: 1, 2: 1, 7: 7}


def test_large_candidate_that_is_no_cluster(spark):
    """Blocks put aside a large candidate with one pair below the threshold, and sum over all its blocks."""
    x = np.tile([1.0, 0.0], (3000, 1)) + 1e-3 * np.random.default_rng(0).standard_normal((3000, 2))
    x[2999] = [0.5, 1.0]
    rows = spark.createDataFrame([(c, i, 1, bytearray(v.tobytes())) for c in (1, 2) for i, v in enumerate(x[: 3000 if c == 1 else 2999])], "cluster long, id long, w int, vec binary")
    large = spark.createDataFrame([(1, 3, 3000), (2, 3, 2999)], "cluster long, m int, total long")
    got = markov._checked_by_blocks(rows, large, 2, 0.9, 3).toPandas()
    assert len(got) == 2999 and set(got.clust) == {0} and got.typical.sum() == 1


def test_markov_flow_parts_two_groups(spark):
    edges = [(a, b, 1.0) for g in (range(5), range(10, 15)) for a, b in itertools.combinations(g, 2)] + [(4, 10, 0.1), (1, None, 1.0), (2, 2, 1.0)]
    got = {r["id"]: r["cluster"] for r in markov.markov_clusters(spark.createDataFrame(edges, "src long, dst long, w double")).collect()}
    assert got == {i: 0 if i < 5 else 10 for i in [*range(5), *range(10, 15)]}


def test_chosen_path(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(60):
        base = rng.choice(10_000, 30, replace=False)
        data.append((2 * i, base.tolist()))
        other = base.copy()
        other[: i % 8] = rng.choice(10_000, i % 8) + 20_000
        data.append((2 * i + 1, other.tolist()))
    data += [(500, None), (None, [1, 2]), (501, [])] + [(600 + i, list(range(40))) for i in range(4)]
    got = {tuple(r) for r in chosen_path.similar_sets(spark.createDataFrame(data, "id long, tokens array<long>"), 0.6).collect()}
    sets = {i: set(t) for i, t in data if i is not None and t}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert got == want
    assert chosen_path.similar_sets(spark.createDataFrame([], "id long, tokens array<long>"), 0.6).count() == 0


def test_runs_reach_the_recall_at_the_last_level():
    """One set inside the other: one shared chosen token a level on average, over all levels of a run."""
    rng, pairs = np.random.default_rng(7), 200_000
    alive = np.ones((pairs, chosen_path.runs_for()), np.int64)
    for _ in range(chosen_path.LEVELS):
        alive = rng.poisson(alive)
    assert (alive > 0).any(1).mean() > 0.989


def test_large_bucket_is_compared_in_blocks(spark):
    data = [(i, [*range(30), 1000 + i]) for i in range(80)]
    sets = chosen_path.sketched(spark.createDataFrame(data, "id long, tokens array<long>"))
    got = chosen_path.candidate_pairs(sets, 0.8, 128, runs=3, leaf=8, levels=2, block=24)
    assert got.count() == 80 * 79 // 2


def test_grid_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 200)] + [(300, 301 + i) for i in range(50)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {tuple(r) for r in grid_components.connected_groups(df).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)} | {(300 + i, 300) for i in range(51)}
    assert grid_components.connected_groups(df.limit(0)).count() == 0


def test_grid_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(grid_components, "CELL_EDGES", 5)
    df = spark.createDataFrame([(i, (i * 7 + 3) % 90) for i in range(90)] + [(200, 201)], "u long, v long")
    root = list(range(202))
    find = lambda x: x if root[x] == x else find(root[x])
    for u, v in [(i, (i * 7 + 3) % 90) for i in range(90)] + [(200, 201)]:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    members = {x for u, v in [(i, (i * 7 + 3) % 90) for i in range(90)] if u != v for x in (u, v)} | {200, 201}
    assert {tuple(r) for r in grid_components.connected_groups(df).collect()} == {(x, find(x)) for x in members}


def test_tokenizer_against_public_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokenizer.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    peer = tiktoken.Encoding("peer", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(0)
    letters = list("aab  \n\t'stremvld19!?é中😀 　​²ßA-=")
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(400)] + ["a" * 20_000, "ab" * 5_000, "it's 'll''re '", "x'", "a\n\n", "", None, "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode_documents(df).collect()}
    assert got == {i: peer.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert tokenizer.encode_documents(df.limit(0)).count() == 0
    counts = {r["doc_id"]: r["n"] for r in tokenizer.count_tokens(df).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


def test_tokenizer_tells_pieces_of_one_hash_apart():
    """The words of Thue and Morse over two letters have equal polynomial hashes modulo 2^64."""
    bits = np.array([bin(i).count("1") % 2 for i in range(4096)], np.uint8)
    one, two = bits + ord("a"), 1 - bits + ord("a")
    with open(tokenizer.VOCABULARY, "rb") as f:
        merge = tokenizer.merges(f.read())
    alone = [tokenizer.encode_texts(w, np.array([0, 4096]), merge)[0].tolist() for w in (one, two)]
    ids, count = tokenizer.encode_texts(np.concatenate([one, two, one]), np.array([0, 4096, 8192, 12288]), merge)
    assert alone[0] != alone[1] and np.split(ids, np.cumsum(count)[:-1])[1].tolist() == alone[1]
    assert ids.tolist() == alone[0] + alone[1] + alone[0]


def test_long_pieces_have_a_bucket_for_each_rank():
    with open(tokenizer.VOCABULARY, "rb") as f:
        merge = tokenizer.merges(f.read())
    data = np.frombuffer(("thelongestwordofall" * 40 + "aaaaabab" * 90).encode(), np.uint8)
    for width in (1, 7, tokenizer.WIDTH):
        assert merge.merged(data, np.array([len(data)]), width)[0].tolist() == merge.merged(data, np.array([len(data)]), 1)[0].tolist()


def test_packing(spark):
    rng = np.random.default_rng(4)
    sizes = [(i, int(n)) for i, n in enumerate(np.minimum(rng.lognormal(6, 1, 3000), 9000))] + [(5000, 0), (5001, None), (None, 4), (5002, 2048), (5003, 4096)]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id long, n long"), shard=1000).toPandas()
    assert got.groupby("container").n_tokens.sum().max() <= 2048
    total = {i: n or 0 for i, n in sizes if i is not None}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == total
    assert (got.groupby("doc_id").container.count() == [max(1, -(-total[i] // 2048)) for i in sorted(total)]).all()
    assert got.n_tokens.sum() / (got.container.nunique() * 2048) > 0.98


@pytest.mark.parametrize("text,case", [
    ("Subject: x\n\nHello,\n\n" + "garden hose * lab coat * travel mug * cheap lab coat * " * 6, True),
    ("Subject: x\n\nHello,\n\n" + "\n".join(f"- https://shop{i}.example/a?id={i}" for i in range(12)), True),
    ("Subject: x\n\nHello,\n\nI would buy the lab coat online, since the best deal ends on Friday. We have seen that it works.\n\n- gel comb\n- phone case\n", False),
    ("Subject: x\n\nHi,\n\nok\n\nOn Mon, 4 Mar 2024, A B wrote:\n> " + "garden hose * lab coat * " * 20, False),
    ("Subject: x\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(b"sale lab coat; lab coat sale; cheap lab coat; " * 9).decode(), True),
    ("", False), ("   ", False), (None, False),
])
def test_stuffed(spark, text, case):
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert [r["doc_id"] for r in stuffed.stuffed_documents(df).collect()] == ([1] if case else [])


def _multipart(parts, mark="=_b"):
    return f"Content-Type: multipart/alternative; boundary=\"{mark}\"\n\n" + "".join(f"--{mark}\n{p}\n" for p in parts) + f"--{mark}--\n"


def test_stuffed_in_any_part(spark):
    """The HTML part counts beside the plain one, once where both say the same; at any depth, length and place."""
    words = "garden hose * lab coat * travel mug * cheap lab coat * " * 6
    plain = lambda t: f"Content-Type: text/plain\n\n{t}"
    page = lambda t: f"Content-Type: text/html\n\n<html><body><p>{t}</p></body></html>"
    nested = plain(words)
    for i in range(6):
        nested = _multipart([nested], f"=_b{i}")
    clauses = "We have seen that the coat is in the lab and that it was not as cheap as the mug. " * 3
    texts = {
        1: (_multipart([plain("We will be in the lab until Friday."), page(words)]), True),
        2: (_multipart([plain(clauses * 3), page(words)]), False),
        3: (_multipart([plain(words[: len(words) // 6]), page(clauses[: len(clauses) // 3])]), False),
        4: (_multipart([plain(clauses + "\n\n" + words), page(clauses + "</p><p>" + words)]), len(words) > len(clauses)),
        5: (nested, True),
        6: ("Subject: x\n\nlab coat; gel comb; lab coat; gel comb", True),
        7: ("Subject: x\n\n" + " " * 2500 + "<html><body><blockquote>" + words + "</blockquote><p>That is what we have seen.</p></body></html>", False),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    assert {r["doc_id"] for r in stuffed.stuffed_documents(df).collect()} == {i for i, (_, case) in texts.items() if case}


def test_stuffing_is_what_repeats_cover(monkeypatch):
    """Without repeats nothing is stuffing, whatever its form; sentences are none, however often they repeat."""
    words = "garden hose * lab coat * travel mug * cheap lab coat * " * 6
    links = "\n".join(f"- https://shop{i}.example/a?id={i}" for i in range(12))
    said = "We have seen the coat. " * 20
    own = lambda t: stuffed.stuffing("Subject: x\n\n" + t)
    assert all(s > 0.9 * n > 0 for s, n in map(own, (words, links))) and own(said)[0] == 0
    monkeypatch.setattr(stuffed, "repeated", lambda x: [0] * len(x))
    assert own(words)[0] == own(links)[0] == 0


def test_suffix_automaton_against_all_substrings():
    rng = np.random.default_rng(9)
    for _ in range(50):
        s = rng.integers(0, 3, 14).tolist()
        occurs = lambda x: sum(s[i : i + len(x)] == x for i in range(len(s)))
        want = [max((n for n in range(i + 2) if n == 0 or occurs(s[i - n + 1 : i + 1]) > 1), default=0) for i in range(len(s))]
        assert stuffed.repeated(s) == want


def test_vector_bytes_round_trip():
    for kind in (np.float16, np.float32, np.float64):
        x = np.random.default_rng(0).standard_normal((5, 48)).astype(kind).astype(np.float64 if kind is np.float64 else np.float32)
        assert (posting_lists.from_binary(posting_lists.binary(posting_lists.to_bytes(x)), 48) == x).all()
    assert len(posting_lists.from_binary(pa.array([], pa.binary()), 48)) == 0
