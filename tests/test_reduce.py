import numpy as np

from strandflow.operators import reduce


def test_pca_keeps_distances_of_a_plane(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 2)) @ rng.standard_normal((2, 6)) + 3
    got = reduce.pca(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, emb array<double>"), 2).orderBy("idx").toPandas()
    p = np.array(got["reduced"].tolist())
    far = lambda m: np.linalg.norm(m[:, None] - m[None], axis=2)
    assert np.allclose(far(p), far(x))


def test_combat_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((12, 5)) * (1 + s) + 2 * s for s in range(3)])
    seq = np.repeat(np.arange(3), 12)
    rows = [("f", int(s), i, v.tolist()) for i, (s, v) in enumerate(zip(seq, x))] + [("f", 9, 99, [1.0] * 5)]
    df = spark.createDataFrame(rows, "fasta string, seqnum int, idx long, emb array<double>")
    got = {r["idx"]: r["emb"] for r in reduce.combat(df).collect()}
    assert got[99] == [1.0] * 5  # a batch of one stays
    means = np.array([x[seq == s].mean(0) for s in range(3)])
    grand, sd = means.mean(0), np.sqrt(((x - means[seq]) ** 2).mean(0))
    z, want = (x - grand) / sd, np.empty_like(x)
    for s in range(3):
        b = z[seq == s]
        gh, dh = b.mean(0), b.var(0, ddof=1)
        m, s2 = dh.mean(), dh.var()
        a, bb, t2 = (2 * s2 + m * m) / s2, (m * s2 + m**3) / s2, gh.var()
        g, d = gh, dh
        for _ in range(300):
            g = (t2 * len(b) * gh + d * gh.mean()) / (t2 * len(b) + d)
            d = (0.5 * ((b - g) ** 2).sum(0) + bb) / (len(b) / 2 + a - 1)
        want[seq == s] = (b - g) / np.sqrt(d) * sd + grand
    assert np.allclose([got[i] for i in range(36)], want, atol=5e-3)
