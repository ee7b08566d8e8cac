import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeq.functions import hashing
from latticeq.operators import groups, ingest, ranking, roc, specs, training
from latticeq.operators.graph import components


def test_orientations_equal_those_of_the_turned_image():
    from latticeq.functions.images import cosine_block

    image = np.random.default_rng(0).uniform(0, 255, (32, 32))
    block = cosine_block(image).ravel()
    for k in range(8):
        flip, turns = divmod(k, 4)
        other = image[:, ::-1] if flip else image
        for _ in range(turns):
            other = np.rot90(other)
        made = np.array([block[i] * s for i, s in hashing.orientation_index(k)])
        assert np.allclose(made, cosine_block(other).ravel(), atol=1e-9), k


def test_near_pairs_are_not_symmetric_and_lose_none(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 12)
    rows = []
    for pos in range(60):
        own = int(base[pos % 12]) ^ int(sum(1 << int(b) for b in rng.choice(60, rng.integers(0, 6), replace=False)))
        rows.append((pos, [own] + [int(x) for x in rng.integers(-(2**62), 2**62, 7)]))
    rows.append((60, rows[0][1]))
    df = spark.createDataFrame(rows, "pos bigint, hash array<bigint>")
    for spare in (1, 2):
        full = {(r.a, r.b) for r in hashing.near_pairs_full(df, 6, spare=spare).collect()}
        brute = {(a, b) for a, ha in rows for b, hb in rows if a < b and min(bin((x ^ hb[0]) & (2**64 - 1)).count("1") for x in ha) <= 6}
        assert full == brute
    found = components(hashing.near_pairs(df, 6)), components(spark.createDataFrame(sorted(brute), "a bigint, b bigint"))
    assert sorted(map(tuple, found[0].collect())) == sorted(map(tuple, found[1].collect()))


def test_keys_grow_with_the_rows():
    assert [hashing.spare_for(n, 6) for n in (10, 2_000, 100_000, 1 << 40)] == [1, 2, 3, 4]


def test_components_chain_loops_nulls_and_empty(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7), (None, 3), (5, 4)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_position_is_total_and_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = ingest.with_position(df, "k").collect()
    assert all(r.k == r.pos for r in got) and len(got) == 1000


@pytest.mark.parametrize("n", [3, 5, 10, 11])
def test_split_cuts_down_to_whole_groups(spark, n):
    rows = spark.range(n).select(F.col("id").alias("group"))
    for draw in ("md5", "numpy"):
        got = {r.split: r["count"] for r in groups.split_groups(rows, draw=draw).groupBy("split").count().collect()}
        assert got.get("train", 0) == int(0.7 * n) and got.get("val", 0) == int(0.1 * n) and sum(got.values()) == n


def test_classification_only_accepted_rows_leave_a_digest(spark):
    rows = [(0, "x", 50, True), (1, "x", 50, True), (2, "x", 200, False), (3, "x", 200, True), (4, "x", 200, True), (5, "y", 200, None), (6, None, 200, True)]
    df = spark.createDataFrame(rows, "pos int, digest string, side int, ok boolean")
    got = {r.pos: r.status for r in ingest.classify(df, F.col("digest"), F.col("side"), F.col("ok"), F.col("pos")).collect()}
    assert [got[i] for i in range(6)] == ["small", "small", "bad", "kept", "dup", "bad"]
    named = df.selectExpr("*", "1 AS entry_digest", "2 AS `a.b`", "3 AS first_order")
    out = ingest.classify(named, F.col("digest"), F.col("side"), F.col("ok"), F.col("pos"))
    assert out.columns == [*named.columns, "status"] and {r.pos: r.status for r in out.collect()} == got
    with pytest.raises(ValueError):
        ingest.require_rows(df)


def test_names(spark):
    paths = ["/d/a/versions/3/x_jpg.rf.abc.JPG", "/d/b/plain.png", "noslash"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    p = F.col("p")
    got = df.select(ingest.base_name(p), ingest.stem(p), ingest.suffix(p), ingest.source_stem(p), ingest.source_key(F.lit("s"), p), ingest.parent_name(p)).collect()
    assert [tuple(r) for r in got] == [
        ("x_jpg.rf.abc.JPG", "x_jpg.rf.abc", ".jpg", "x_jpg", "s/x_jpg", "3"),
        ("plain.png", "plain", ".png", "plain.png", "/d/b/plain.png", "b"),
        ("noslash", "noslash", "", "noslash", "noslash", ""),
    ]
    roots = spark.createDataFrame([("/d/a/versions/3",), ("/d/b/",)], "r string").select(ingest.source_name(F.col("r")).alias("n"))
    assert [r.n for r in roots.collect()] == ["a", "b"]


def brute_roc(scored):
    pos, neg = sum(y for _, y in scored), sum(not y for _, y in scored)
    auc = sum((s > t) + 0.5 * (s == t) for s, y in scored if y for t, z in scored if not z) / pos / neg
    points = [(0, 0, float("inf"))] + [(sum(y for s, y in scored if s >= t), sum(not y for s, y in scored if s >= t), t) for t in sorted({s for s, _ in scored}, reverse=True)]
    return auc, points, pos, neg


def test_roc_with_ties(spark):
    rng = np.random.default_rng(5)
    scored = [(float(np.round(rng.normal(y * 0.7), 1)), bool(y)) for y in rng.integers(0, 2, 300)]
    points = roc.curve(spark.createDataFrame(scored, "s double, same boolean"))
    auc, brute, pos, neg = brute_roc(scored)
    assert abs(roc.auc(points).first()["auc"] - auc) < 1e-12
    kept = [(r.tp, r.fp) for r in roc.corners(points).orderBy("k").collect()]
    assert set(kept) <= {(a, b) for a, b, _ in brute} and kept[0] == (0, 0) and kept[-1] == (pos, neg)
    best = min(((abs((1 - a / pos) - b / neg), i) for i, (a, b) in enumerate(kept)))
    e = roc.equal_error(roc.corners(points)).first()
    a, b = kept[best[1]]
    assert abs(e["eer"] - ((1 - a / pos) + b / neg) / 2) < 1e-12
    at = roc.at_threshold(spark.createDataFrame(scored, "s double, same boolean"), F.lit(0.3)).first()
    assert abs(at["acc"] - np.mean([(s >= 0.3) == y for s, y in scored])) < 1e-12


def test_roc_of_constant_scores(spark):
    points = roc.curve(spark.createDataFrame([(0.5, True), (0.5, False)], "s double, same boolean"))
    assert roc.auc(points).first()["auc"] == 0.5
    assert roc.accept_at(roc.corners(points)).first()["tar_0"] == 0.0


def test_ranking_ties_and_blocks(spark, monkeypatch):
    g = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 2, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 3, [0.0, 1.0])], "g bigint, g_label bigint, g_vec array<double>")
    q = spark.createDataFrame([(9, 2, [1.0, 0.0]), (8, 7, [0.0, 1.0])], "q bigint, q_label bigint, q_vec array<double>")
    met = ranking.scores(q, g)
    assert [(r.g_label, r.rank) for r in ranking.identify(met).where("q = 9").orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    rows = {r.q: r for r in ranking.per_query(met).collect()}
    assert rows[9].first_hit == 2 and rows[9].ap == 0.5 and rows[8].first_hit is None and rows[8].ap == 0.0
    assert ranking.identification(ranking.per_query(met)).first()["r10"] is None
    in_rows = sorted(map(str, ranking.ranked(q, g).collect()))
    assert in_rows == sorted(map(str, ranking.per_query(met).collect()))
    alone = ranking.ranked(g.selectExpr("g AS q", "g_label AS q_label", "g_vec AS q_vec"), g, apart=True).collect()
    assert {r.q: (r.first_hit, r.n_gallery) for r in alone} == {0: (2, 3), 1: (None, 3), 2: (1, 3), 3: (None, 3)}
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 100)
    assert sorted(map(str, ranking.scores(q, g).collect())) == sorted(map(str, met.collect()))
    assert sorted(map(str, ranking.ranked(q, g).collect())) == in_rows
    assert ranking.ranked(q, g.where("false")).count() == 0 or all(r.n_gallery == 0 for r in ranking.ranked(q, g.where("false")).collect())


def test_contrastive_loss_equals_numpy(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(12, 4))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = rng.integers(0, 4, 12)
    rows = [(0, i, int(y[i]), z[i].tolist()) for i in range(12)]
    got = training.contrastive_loss(spark.createDataFrame(rows, "batch_id bigint, id bigint, label bigint, vec array<double>")).first()
    x = z @ z.T / 0.07
    np.fill_diagonal(x, -np.inf)
    logp = x - np.log(np.exp(x).sum(1, keepdims=True))
    same = (y[:, None] == y) & ~np.eye(12, dtype=bool)
    per = [-(logp[i][same[i]]).mean() for i in range(12) if same[i].any()]
    assert abs(got["loss"] - np.mean(per)) < 1e-9 and got["n_anchors"] == len(per)


def test_specs_count_and_never_pair_with_themselves(spark):
    designs, photos = spark.range(5).select(F.col("id").alias("label")), spark.createDataFrame([(1, "b"), (1, "a"), (4, "c")], "label bigint, photo string")
    s = specs.build(designs, photos)
    assert s.count() == 16 * 5 + 3 and s.select("spec_id").distinct().count() == 83 and s.agg(F.max("spec_id")).first()[0] == 82
    assert s.where("donor_label = label").count() == 0
    p = specs.pairs(designs)
    assert {r.kind: r["count"] for r in p.groupBy("kind").count().collect()} == {"genuine": 10, "impostor_random": 10, "impostor_samepal": 10}
    named = p.join(s.select(F.col("spec_id").alias("a"), F.col("label").alias("la")), "a").join(s.select(F.col("spec_id").alias("b"), F.col("label").alias("lb")), "b")
    assert named.where("(kind = 'genuine') <> (la = lb)").count() == 0 and named.count() == 30
    rows = {r.spec_id: r for r in s.collect()}
    same = [(rows[r.a], rows[r.b]) for r in p.where("kind = 'impostor_samepal'").collect()]
    assert len(same) == 10 and all(a.pal_seed == b.pal_seed is not None and a.round == b.round and not a.aug and not b.aug for a, b in same)
    assert sorted(r.photo for r in rows.values() if r.role == "rephoto") == ["a", "b", "c"]
    with pytest.raises(ValueError):
        specs.build(spark.range(2).select(F.col("id").alias("label")))
