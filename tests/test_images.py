import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticeq.functions import images
from latticeq.operators import specs, training
from latticeq.operators.matcher import CatalogMatcher, thumbnail_embedder
from latticeq.plans import imaging, registry
from latticeq.sources import files
from latticeq.streaming import incremental

from .helpers import SMALL, png


def pattern(seed, h=120, w=140):
    rng = np.random.default_rng(seed)
    return images.as_bytes(images.resize(rng.uniform(0, 255, (6, 7, 3)), h, w))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "cat" / "versions" / "2"
    for k in range(12):
        png(root / f"d{k}" / f"p{k}.png", pattern(k))
    png(root / "d0" / "again.PNG", np.clip(pattern(0).astype(int) + 3, 0, 255).astype(np.uint8))
    png(root / "d1" / "turned.png", np.rot90(pattern(1)).copy())
    (root / "copy.png").write_bytes((root / "d2" / "p2.png").read_bytes())
    (root / "junk.jpg").write_bytes(b"no image")
    png(root / "small.png", pattern(50, 40, 200))
    png(root / "d3" / "x_png.rf.aaa.png", pattern(60))
    png(root / "d3" / "x_png.rf.bbb.png", pattern(61))
    (root / "notes.txt").write_text("x")
    return str(root)


def test_prepare_groups_splits_and_counts(spark, tree, tmp_path):
    manifest, counts = files.prepare(spark, [tree])
    rows = {r.path.split("/")[-1]: r for r in manifest.collect()}
    c = counts.first()
    assert (c.n_kept, c.n_bad, c.n_small, c.n_dup) == (16, 1, 1, 1)
    assert all(r.source == "cat" for r in rows.values())
    assert rows["again.PNG"].group == rows["p0.png"].group and rows["turned.png"].group == rows["p1.png"].group
    assert rows["x_png.rf.aaa.png"].group == rows["x_png.rf.bbb.png"].group
    ids = [r.group for r in sorted(rows.values(), key=lambda r: r.pos)]
    assert list(dict.fromkeys(ids)) == sorted(set(ids)) == list(range(len(set(ids))))
    assert all(len({r.split for r in rows.values() if r.group == g}) == 1 for g in ids)
    files.write_manifest(manifest, str(tmp_path / "m"))
    back = files.read_manifest(spark, str(tmp_path / "m"))
    assert [r.path for r in back.collect()] == [r.path for r in manifest.orderBy("pos").collect()]
    assert files.read_manifest(spark, str(tmp_path / "m"), "train").count() == sum(r.split == "train" for r in rows.values())


def test_matcher_and_cache(spark, tree, tmp_path):
    root = tmp_path / "gallery"
    for k in range(4):
        png(root / f"g{k}" / "a.png", pattern(k))
    png(root / "alone.png", pattern(9))
    m = CatalogMatcher(spark, thumbnail_embedder(), tau=0.9, size=64)
    index = m.build_index(str(root), str(tmp_path / "index"))
    assert {r.label for r in index.collect()} == {"g0", "g1", "g2", "g3", "alone"}
    best = m.identify(f"{tree}/d2/p2.png", index, 3).collect()
    assert len(best) == 3 and best[0].label == "g2" and best[0].rank == 1 and best[0].score > 0.99
    assert m.verify(f"{tree}/d2/p2.png", f"{root}/g2/a.png")[0] and not m.verify(f"{tree}/d2/p2.png", f"{root}/g1/a.png")[0]
    with pytest.raises(Exception, match="cannot decode"):
        m.embed(f"{tree}/junk.jpg").collect()
    for _ in range(2):
        files.write_cache(files.decode(spark, str(root)), 64, str(tmp_path / "cache"))
    assert {(r.height, r.width) for r in spark.read.parquet(str(tmp_path / "cache")).collect()} == {(64, 75)}
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 5
    stored = {r.path.split("/")[-1]: files.pixels(r.asDict()) for r in files.read_cache(spark, str(tmp_path / "cache")).collect()}
    assert np.array_equal(stored["alone.png"], images.resize_short(pattern(9), 64))


def test_incremental_ingest_keeps_each_content_once(spark, tree, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    incremental.append_to(incremental.new_files(spark, tree), out, mark).awaitTermination()
    n = spark.read.parquet(out).count()
    assert n == 18  # 19 image names, one of them a copy
    incremental.append_to(incremental.new_files(spark, tree), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == n
    incremental.append_to(incremental.new_files(spark, tree), out, f"{mark}-2").awaitTermination()  # all come again, no state is left
    assert spark.read.parquet(out).count() == n


# ---- pixel operations on stacks, against plain loops over single pixels


def stack_of(n, side=20):
    return np.stack([pattern(40 + k, side, side) for k in range(n)])


def test_sizes_and_windows():
    x = pattern(3)
    assert images.resize_short(x, 60).shape == (60, 70, 3) and images.resize_short(x, 500) is x
    assert images.center_crop(x, 224).shape == (224, 224, 3) and np.array_equal(images.center_crop(x, 120), x[:, 10:130])
    y = x[:, :, 0].astype(float)
    assert np.allclose(images.resampled(y, (12, 20, 60, 80), 20, 16), y[12:72, 20:100].reshape(20, 3, 16, 5).mean((1, 3)))
    assert np.allclose(images.resize(np.array([[0.0, 10.0]]), 1, 4), [[0, 2.5, 7.5, 10]])
    h, w = np.full(500, 120), np.full(500, 140)
    at = images.crop_windows(h, w, images.Draws(np.arange(500)))
    assert (at[:, 0] + at[:, 2] <= 120).all() and (at[:, 1] + at[:, 3] <= 140).all() and (at[:, 2:] > 0).all() and (at >= 0).all()
    share, shape = at[:, 2] * at[:, 3] / (120 * 140), at[:, 3] / at[:, 2]
    assert 0.34 < share.min() < 0.38 and share.max() > 0.8 and 0.74 < shape.min() < 0.8 and 1.25 < shape.max() < 1.35
    assert (images.crop_windows(np.full(9, 5), np.full(9, 500), images.Draws(np.arange(9)), (0.9, 1.0)) == 0).all()
    thin = pattern(5, 30, 300)
    assert np.array_equal(images.random_crops([thin], 24, images.Draws([1]), (0.9, 1.0))[0], images.center_crop(thin, 24))


def test_draws_depend_on_the_row_only():
    seeds = np.arange(40)
    whole, alone = images.Draws(seeds), [images.Draws(s) for s in seeds]
    assert np.array_equal(whole.uniform(5), np.concatenate([d.uniform(5) for d in alone]))
    assert np.array_equal(whole.fork(2).normal(3), np.concatenate([d.fork(2).normal(3) for d in alone]))
    u, z = images.Draws(np.arange(4000)).uniform(10), images.Draws(np.arange(4000)).normal(10)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.002 and abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02
    assert abs(np.corrcoef(u[:-1, 0], u[1:, 0])[0, 1]) < 0.05 and sorted(set(images.Draws(seeds).below(3))) == [0, 1, 2]
    assert all(sorted(o) == list(range(7)) for o in images.Draws(seeds).order(7))


def test_lab_there_and_back():
    x = pattern(3)
    assert np.abs(images.from_lab(images.to_lab(x)).astype(int) - x).max() <= 1


def test_centers_equal_loops():
    lab = images.to_lab(stack_of(4)).reshape(4, -1, 3)
    k = np.array([6, 3, 5, 7])
    found = images.centers_of(lab, k, images.Draws(np.arange(4)), sample=150)
    for i in range(4):
        d = images.Draws(i)
        some = lab[i][d.order(400)[0][:150]]
        own = some[d.order(150)[0][: k[i]]].copy()
        for _ in range(8):
            near = [min(range(k[i]), key=lambda c, p=p: (((p - own[c]) ** 2).sum(), c)) for p in some]
            for c in range(k[i]):
                members = [p for p, m in zip(some, near) if m == c]
                if members:
                    own[c] = np.mean(members, 0)
        own = own[np.argsort(own[:, 0], kind="stable")]
        assert found.sizes[i] == k[i] and np.allclose(found.colors[i, : k[i]], own, atol=1e-6)
    tiny = images.centers_of(np.full((1, 2, 3), 7.0), np.array([6]), images.Draws([0]))
    assert tiny.sizes[0] == 2 and (tiny.colors == 7).all()


def test_merging_and_shares_equal_loops():
    rng = np.random.default_rng(4)
    colors = rng.uniform(90, 160, (30, 6, 3))
    live = np.arange(6) < rng.integers(2, 7, 30)[:, None]
    palettes = images.Palettes(colors, live).sorted()
    got = images.merged(palettes)

    def gap(a, b):
        return 0.35 * (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2

    for r in range(30):
        own = [c for c, on in zip(palettes.colors[r], palettes.live[r]) if on]
        while len(own) > 2:
            d, i, j = min((gap(own[i], own[j]), i, j) for i in range(len(own)) for j in range(i + 1, len(own)))
            if d >= 22**2:
                break
            middle = (own[i] + own[j]) / 2
            own = [c for k, c in enumerate(own) if k not in (i, j)] + [middle]
        own = np.array(sorted(own, key=lambda c: c[0]))
        assert got.sizes[r] == len(own) and np.allclose(got.colors[r, : len(own)], own)
    x = rng.uniform(80, 170, (30, 9, 3))
    share = images.shares(x, got)
    for r in range(30):
        for p in range(9):
            raw = [math.exp(-gap(x[r, p], got.colors[r, c]) / 60) if got.live[r, c] else 0.0 for c in range(6)]
            assert np.allclose(share[r, p], np.array(raw) / sum(raw))
    target = images.Palettes(rng.uniform(0, 255, (30, 6, 3)), np.ones((30, 6), bool))
    fit = images.fitted(target, got.sizes, 6)
    for r in range(30):
        ordered, n = sorted(target.colors[r].tolist()), got.sizes[r]
        assert np.allclose(fit[r, :n], [ordered[round(k * 5 / (n - 1))] for k in range(n)])


def test_random_palettes():
    many = images.random_palettes(np.full(300, 6), images.Draws(np.arange(300)))
    for p in many.colors:
        assert all(np.linalg.norm(a - b) >= 35 for i, a in enumerate(p) for b in p[:i]) and (25 <= p[:, 0]).all() and (p[:, 0] < 235).all()
    assert abs(many.colors[..., 1:].mean() - 128) < 4 and 38 < many.colors[..., 1:].std() < 52
    assert (np.diff(many.colors[..., 0], axis=1) < 0).any()  # as they come, not by lightness
    alone = images.random_palettes(np.array([6]), images.Draws(17))
    assert np.array_equal(alone.colors[0], many.colors[17])
    far = images.random_palettes(np.array([4]), images.Draws(1), apart=400.0)
    assert far.colors[0, 1:].tolist() == [[63.75, 128, 128], [127.5, 128, 128], [191.25, 128, 128]]


def test_repainting():
    x = stack_of(6)
    targets = images.Palettes(images.random_palettes(np.full(6, 6), images.Draws(np.arange(6) + 50)).colors, np.ones((6, 6), bool))
    for mode in ("random", "permute", "transfer"):
        got = images.repaint(x, np.full(6, mode), targets, images.Draws(np.arange(6)), 6, 0.0)
        one = np.concatenate([images.repaint(x[k : k + 1], np.array([mode]), images.Palettes(targets.colors[k : k + 1], targets.live[k : k + 1]), images.Draws(k), 6, 0.0) for k in range(6)])
        assert np.array_equal(got, one) and got.shape == x.shape and not np.array_equal(got, x)
    got = images.repaint(x, np.full(6, "transfer"), targets, images.Draws(np.arange(6)), 6, 0.0)
    for r in range(6):
        d = images.Draws(r)
        lab = images.to_lab(x[r]).reshape(1, -1, 3)
        own = images.merged(images.centers_of(lab, np.array([6]), d))
        d.one()
        n = own.sizes[0]
        new = np.array(sorted(targets.colors[r].tolist()))[[round(k * 5 / max(n - 1, 1)) for k in range(n)]]
        share = images.shares(lab, own)[0][:, :n]
        rest = lab[0] - share @ own.colors[0, :n]
        rest[:, 1:] *= d.one(0.3, 1.0)
        assert np.abs(images.from_lab(share @ new + rest).reshape(x[r].shape).astype(int) - got[r]).max() <= 1


def test_families_equal_loops():
    import colorsys

    x, seeds = stack_of(5, 8), np.arange(5)
    hue = images.turned_hue(x, np.full(5, 50.0), np.full(5, 1.2), np.full(5, 0.8))
    for at in np.ndindex(5, 8, 8):
        h, s, v = colorsys.rgb_to_hsv(*(x[at] / 255.0))
        h2 = math.floor((round(h * 180) % 180 + 50) % 180)
        s2, v2 = math.floor(min(round(s * 255) * 1.2, 255)), math.floor(255 * v**0.8)
        assert np.abs(np.array(colorsys.hsv_to_rgb(h2 / 180, s2 / 255, v2 / 255)) * 255 - hue[at]).max() <= 3
    tables = images.tone_tables(images.Draws(seeds))
    got = images.recolor(x, np.full(5, "curves"), images.Draws(seeds))
    d = images.Draws(seeds)
    inner, low, high, falls = d.uniform(18, 0, 255).reshape(5, 3, 6), d.uniform(3, 0, 60), d.uniform(3, 195, 255), d.uniform(3)
    for r in range(5):
        for c in range(3):
            knots = sorted(inner[r, c])
            knots[0], knots[-1] = low[r, c], high[r, c]
            knots = knots[::-1] if falls[r, c] < 0.5 else knots
            assert np.array_equal(tables[r, c], np.interp(np.arange(256), np.linspace(0, 255, 6), knots).astype(np.uint8))
            assert np.array_equal(got[r, ..., c], tables[r, c][x[r, ..., c]])
    ref = stack_of(10, 8)[5:]
    got = images.recolor(x, np.full(5, "reinhard"), images.Draws(seeds), None, ref)
    for r in range(5):
        a, b = images.to_lab(x[r]), images.to_lab(ref[r])
        want = np.stack([(a[..., c] - a[..., c].mean()) / (a[..., c].std() + 1e-3) * (b[..., c].std() + 1e-3) + b[..., c].mean() for c in range(3)], -1)
        assert np.abs(images.from_lab(want).astype(int) - got[r]).max() <= 1
    free = images.to_lab(images.recolor(np.repeat(x, 60, 0), np.full(300, "reinhard"), images.Draws(np.arange(300))))
    assert 60 < free[..., 0].mean((1, 2)).min() and free[..., 0].mean((1, 2)).max() < 200
    gray = images.recolor(np.repeat(x, 60, 0), np.full(300, "gray"), images.Draws(np.arange(300)))
    flat = images.luma(np.repeat(x, 60, 0))
    inverted = [np.array_equal(g[..., 0], 255 - f) for g, f in zip(gray, flat)]
    assert all(inv or np.array_equal(g[..., 1], f) for g, f, inv in zip(gray, flat, inverted)) and 0.2 < np.mean(inverted) < 0.4
    moved = images.recolor(x, np.full(5, "channel"), images.Draws(seeds))
    for r in range(5):
        assert all(any(np.array_equal(moved[r, ..., c], y) for k in range(3) for y in (x[r, ..., k], 255 - x[r, ..., k])) for c in range(3))
    assert np.array_equal(images.recolor(x, np.full(5, "identity"), images.Draws(seeds)), x)
    mixed = images.recolor(np.repeat(x[:1], 9, 0), np.array(images.FAMILIES), images.Draws(np.arange(9)), np.repeat(targets_of(1), 9, 0))
    for k, f in enumerate(images.FAMILIES):
        assert np.array_equal(mixed[k], images.recolor(x[:1], np.array([f]), images.Draws(k), targets_of(1))[0])
    with pytest.raises(ValueError):
        images.recolor(x, np.full(5, "other"), images.Draws(seeds))


def targets_of(n):
    return images.random_palettes(np.full(n, 6), images.Draws(np.arange(n) + 9)).colors


def test_photo_steps_equal_loops():
    x = stack_of(3, 16)
    sigma = np.array([0.4, 0.9, 1.5])
    got = images.blurred(x, sigma)
    for r in range(3):
        w = [math.exp(-(k**2) / (2 * sigma[r] ** 2)) for k in range(-6, 7)]

        def at(i):
            i = abs(i)
            return 30 - i if i > 15 else i

        for i, j in ((0, 0), (3, 15), (8, 8), (15, 1)):
            want = sum(w[a + 6] * w[b + 6] * x[r, at(i + a), at(j + b)].astype(float) for a in range(-6, 7) for b in range(-6, 7)) / sum(w) ** 2
            assert np.abs(want - got[r, i, j]).max() <= 0.5 + 1e-9
    assert np.array_equal(images.rotated(x, np.zeros(3), np.ones(3)), x)
    quarter = images.rotated(x, np.full(3, 90.0), np.ones(3))
    assert np.abs(quarter[:, 1:, :].astype(int) - np.rot90(x, 1, (1, 2))[:, :-1, :]).max() <= 1 or np.abs(quarter[:, :, 1:].astype(int) - np.rot90(x, 1, (1, 2))[:, :, :-1]).max() <= 1
    smooth = stack_of(3, 96)
    fine, rough = (images.reencoded(smooth, np.full(3, q)).astype(int) for q in (95, 40))
    assert 0 < np.abs(fine - smooth).mean() < np.abs(rough - smooth).mean() < 12
    gray = np.repeat(images.luma(smooth[:1, :16, :16]).astype(np.uint8)[..., None], 3, -1)
    coded = images.reencoded(gray, np.array([40]))[0, ..., 0]
    block, want = gray[0, 8:, :8, 0] - 128.0, np.zeros((8, 8))

    def wave(u, k):
        return math.cos(math.pi * (2 * k + 1) * u / 16) * (0.125**0.5 if u == 0 else 0.5)

    for u in range(8):
        for v in range(8):
            q = (images.JPEG_LUMA[u][v] * 125 + 50) // 100  # quality 40
            c = sum(block[i, j] * wave(u, i) * wave(v, j) for i in range(8) for j in range(8))
            want += round(c / q) * q * np.array([[wave(u, i) * wave(v, j) for j in range(8)] for i in range(8)])
    assert np.abs(coded[8:, :8] - np.clip(want + 128, 0, 255)).max() <= 0.5 + 1e-6
    flat = np.full((1, 16, 16, 3), 77, np.uint8)
    assert np.abs(images.reencoded(flat, np.array([60])).astype(int) - 77).max() <= 2
    seeds = np.arange(60)
    many = np.stack([pattern(k, 16, 16) for k in range(60)])
    out = images.photo(many, images.Draws(seeds))
    assert out.dtype == np.uint8 and all(np.array_equal(out[k], images.photo(many[k : k + 1], images.Draws(k))[0]) for k in range(60))
    plain = [any(np.array_equal(o, np.rot90(y, t)) for y in (m, m[:, ::-1]) for t in range(4)) for o, m in zip(out, many)]
    assert 0.02 < np.mean(plain) < 0.45  # about 0.5 * 0.7 ** 3 * 0.8
    assert images.to_tensor(x[0], gray=True).shape == (3, 16, 16) and images.to_tensor(x).shape == (3, 3, 16, 16)


def test_rendering_passes_the_donor_on():
    x = [pattern(k, 60, 80) for k in range(4)]
    spec = {"op": "colorway", "seed": 5, "strict": False, "family": "reinhard", "pal_seed": None, "aug": None}
    a, b = images.render([spec, spec], [x[0], x[0]], [x[1], x[2]], 32)
    assert not np.array_equal(a, b)
    draws = images.Draws([5])
    cut = images.random_crops([x[0]], 32, draws, (0.5, 1.0))
    want = images.photo(images.matched(cut, draws.fork(1), images.center_crop(x[1], 32)[None]), draws.fork(2), 0.7)
    assert np.array_equal(a, want[0])
    rows = [spec, spec | {"strict": True, "family": "palette_transfer"}, {"op": "orig"}, spec | {"op": "palette", "pal_seed": 4, "aug": True}, spec | {"op": "palette", "pal_seed": 4, "aug": False}]
    out = images.render(rows, [x[0]] * 5, [x[1], x[1], None, None, None], 32)
    for k, r in enumerate(rows):
        assert np.array_equal(out[k], images.render([r], [x[0]], [x[1]], 32)[0])
    assert np.array_equal(out[2], images.center_crop(x[0], 32))
    with pytest.raises(ValueError):
        images.render([{"op": "x"}], [x[0]], [None], 32)


# ---- the registered image queries, against the same work on the driver, a row at a time


def frame_of(spark, name):
    return registry.QUERIES[name](spark, SMALL).toPandas()


@pytest.fixture(scope="module")
def vectors():
    return pd.read_parquet(f"{SMALL}/embeddings.parquet")


def test_palette_hash_and_recolor_queries(spark, vectors):
    pictures = {i: imaging.picture(v) for i, v in zip(vectors["vec_id"], vectors["embedding"])}
    rows = frame_of(spark, "image_palette")
    assert len(rows) == len(vectors)
    for r in rows[::40].itertuples():
        p = images.extract_palettes([pictures[r.id]], [r.id])
        assert np.allclose(np.reshape(r.palette, (6, 3)), p[0], atol=6e-4) and r.n_merged == images.merged(images.Palettes(p, np.ones((1, 6), bool))).sizes[0]
    for r in frame_of(spark, "image_phash_block")[::40].itertuples():
        gray = images.luma(pictures[r.id])
        for k, h in enumerate(r.hash):
            turned = np.rot90(gray[:, ::-1] if k >= 4 else gray, k % 4)
            d = np.array([[sum(turned[y, x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) for v in range(8)] for u in range(8)]).ravel()
            margin = np.abs(d - np.median(d[1:]))
            mine = np.array([h >> (63 - b) & 1 for b in range(64)])
            assert ((mine == (d > np.median(d[1:]))) | (margin < 1e-6)).all()
            if k == 5:
                break
    rows = frame_of(spark, "image_recolor")
    assert len(rows) == 8 * len(vectors)
    order = {f: k for k, f in enumerate(specs.FAMILIES)}
    for r in rows[::200].itertuples():
        out = images.recolor(pictures[r.id][None], np.array([r.family]), images.Draws(r.id * 16 + order[r.family]))
        assert np.allclose((r.r, r.g, r.b), out.mean((1, 2))[0], atol=1e-3)
    for r in frame_of(spark, "image_augment")[::40].itertuples():
        d = images.Draws(r.id)
        assert np.isclose(images.photo(images.random_crops([pictures[r.id]], 24, d), d.fork(0)).mean(), r.mean) and r.height == r.width == 24


def test_render_and_view_queries(spark, vectors):
    own = {label: imaging.picture(g.sort_values("vec_id")["embedding"].iloc[0]) for label, g in vectors.groupby("label")}
    spec = {r.spec_id: r.asDict() for r in specs.build(spark.range(len(own)).select(F.col("id").alias("label"))).collect()}
    rows = frame_of(spark, "render_specs")
    assert sorted(rows["spec_id"]) == sorted(spec)
    for r in rows[::7].itertuples():
        s = spec[r.spec_id]
        assert np.isclose(images.render([s], [own[s["label"]]], [own.get(s["donor_label"])], 32).mean(), r.mean)
    pictures = {i: imaging.picture(v) for i, v in zip(vectors["vec_id"], vectors["embedding"])}
    palettes = {i: images.extract_palettes([p], [i])[0] for i, p in pictures.items()}
    bank = frame_of(spark, "palette_bank").set_index("bank_id")["palette"]
    assert sorted(bank.index) == list(range(24))
    for k in range(12):
        assert any(np.allclose(np.reshape(bank[k], (6, 3)), p) for p in palettes.values())
    for k in range(12, 24):
        assert np.allclose(np.reshape(bank[k], (6, 3)), images.random_palettes(np.array([6]), images.Draws(k + 10_003 * training.BANK_STREAMS)).colors[0])

    def draw(*parts):
        return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:8], 16)

    for name, size in (("train_views", 24), ("train_views_without_bank", 0)):
        rows = frame_of(spark, name)
        assert len(rows) == 4 * len(vectors) and not rows.duplicated(["id", "view"]).any()
        for r in rows[::90].itertuples():
            key = (r.id, r.view)
            if size:
                target = np.reshape(bank[draw(3, "target", *key) % 24], (6, 3))
            elif draw(3, "real", *key) / 2**32 < 0.5:
                target = palettes[draw(3, "target", *key) % len(palettes)]
            else:
                target = images.random_palettes(np.array([6]), images.Draws(draw(3, "random", *key))).colors[0]
            d = images.Draws(draw(3, "view", *key))
            x = images.random_crops([pictures[r.id]], 24, d)
            x = images.recolor(x, np.array([r.family]), d.fork(0), target[None])
            assert np.isclose(images.to_tensor(images.photo(x, d.fork(1))).mean(dtype=float), r.mean, atol=1e-5)


def test_half_precision_query(spark, vectors):
    rows = frame_of(spark, "half_precision_index").set_index("pos")
    for i, v in zip(vectors["vec_id"], vectors["embedding"]):
        half = np.asarray(v, np.float32).astype(np.float16).astype(np.float32)
        assert np.isclose(rows.loc[i, "error"], np.abs(half - np.asarray(v, np.float32)).max()) and np.isclose(rows.loc[i, "norm2"], (half.astype(float) ** 2).sum())


def test_exif_orientation(spark, tmp_path):
    x = pattern(8)
    png(tmp_path / "x.png", x)
    jvm = spark._jvm
    flat = tmp_path / "plain.jpg"
    jvm.javax.imageio.ImageIO.write(jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / "x.png"))), "jpg", jvm.java.io.File(str(flat)))
    raw = flat.read_bytes()
    ways = {1: x, 2: x[:, ::-1], 3: x[::-1, ::-1], 4: x[::-1], 5: x.transpose(1, 0, 2), 6: np.rot90(x, 3), 7: np.rot90(x, 2).transpose(1, 0, 2), 8: np.rot90(x)}
    for k in ways:
        for order in ("little", "big"):
            tiff = (b"II*\0" if order == "little" else b"MM\0*") + (8).to_bytes(4, order) + (1).to_bytes(2, order) + (0x112).to_bytes(2, order) + (3).to_bytes(2, order) + (1).to_bytes(4, order) + k.to_bytes(2, order) + bytes(6)
            part = b"Exif\0\0" + tiff
            data = raw[:2] + b"\xff\xe1" + (len(part) + 2).to_bytes(2, "big") + part + raw[2:]
            assert files.exif_orientation(data) == k
        (tmp_path / "t" / f"o{k}.jpg").parent.mkdir(exist_ok=True)
        (tmp_path / "t" / f"o{k}.jpg").write_bytes(data)
    assert files.exif_orientation(raw) == 1 and files.exif_orientation(b"") == 1 and files.exif_orientation(b"\xff\xd8\xff") == 1
    for r in files.decode(spark, str(tmp_path / "t")).collect():
        k = int(r.path.rsplit("/o", 1)[1][0])
        got = files.pixels(r.asDict())
        assert got.shape == ways[k].shape and np.abs(got.astype(int) - ways[k]).mean() < 6, k


def test_half_precision(spark):
    from latticeq.functions.vectors import half_precision

    df = spark.createDataFrame([([0.1, 70000.0],), (None,)], "v array<float>")
    got = [r.h for r in df.select(half_precision(F.col("v")).alias("h")).collect()]
    assert got[0][0] == float(np.float32(np.float16(0.1))) and got[0][1] == float("inf") and got[1] is None
