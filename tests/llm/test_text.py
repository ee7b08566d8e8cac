"""Quality rules, classifier, BPE, packing and media against plain Python and round trips."""

import base64
import hashlib
import io
import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticeq.llm import bpe, media, packing, quality_model, quality_rules
from latticeq.llm.common import shared_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


PROSE = "the quick fox went over the long bridge and saw that nobody had been there before it came to rest by the water where old trees grow and many small birds sing every morning until the sun is high and warm above all hills around while children walk slowly to school again"
EDGE = ["", None, " \n\t ", "one", PROSE, PROSE, "a" * 200_000, "ab " * 30_000, "é中𝄞 " * 50, "</s><|endoftext|> x", "\x00\x0b\x1f line\r\nnext"]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, EDGE, [*range(len(EDGE) - 1), None])


# ---- quality rules


def brute_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)})


@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeat_words(words):
    assert quality_rules.repeat_words(words) == brute_repeats(words)


def test_line_rules_and_verdict():
    noisy = "\n".join([PROSE, "home | about | help | terms", "buy### now*** here$$$", "ALL THIS IS LOUD TEXT", "All rights reserved.", PROSE])
    found = quality_rules.judge(noisy, common=frozenset([quality_rules.line_hash("All rights reserved.")]))
    assert found["cleaned"] == PROSE and found["n_dup_lines"] == 1 and found["n_symbols"] == 3 + 9
    assert found["base_failed"] and not found["kept"]  # half of it is repeated
    assert quality_rules.judge(PROSE)["kept"]
    assert not quality_rules.judge("\n".join([PROSE] + [f"w{i}### x{i}*** y{i}$$$ z{i}" for i in range(80)]))["kept"]
    for nothing in ("", None, " \n"):
        assert quality_rules.judge(nothing)["base_failed"] and quality_rules.judge(nothing)["n_words"] == 0


def brute_common(texts, least):
    between = {}
    for text in texts:
        lines = (text or "").split("\n")
        for k, line in enumerate(lines):
            if line.strip(" \t\n\x0b\x0c\r"):
                between.setdefault(line, set()).add((lines[k - 1] if k else None, lines[k + 1] if k + 1 < len(lines) else None))
    return {line for line, around in between.items() if len(around) >= least}


def test_common_lines(spark):
    texts = [f"head {k % 9}\nAll rights reserved.\n{PROSE} {k}\n \n- more\nand so on..." for k in range(14)] + ["same\ncopy\nline"] * 40 + [None, "", "All rights reserved."]
    found = quality_rules.common_lines(frame(spark, texts))
    want = brute_common(texts, 10)
    assert "All rights reserved." in want and "copy" not in want and found == {quality_rules.line_hash(x) for x in want}
    assert quality_rules.common_lines(frame(spark, texts).where("false")) == frozenset()
    rows = quality_rules.assess(frame(spark, texts)).orderBy("doc_id").collect()
    assert all(r.cleaned == f"head {k % 9}\n{PROSE} {k}\n " and r.kept for k, r in enumerate(rows[:14]))
    some = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert quality_rules.common_lines(some) == {quality_rules.line_hash(x) for x in brute_common([r.text for r in some.collect()], 10)}


def test_assess_and_keep(spark, odd):
    rows = quality_rules.assess(odd).collect()
    assert len(rows) == len(EDGE)
    extra = odd.selectExpr("*", "doc_id AS kept", "text AS cleaned", "1 AS `a.b`", "2 AS c1")
    kept = quality_rules.keep_clean(extra)
    assert kept.columns == extra.columns
    assert [(r.text, r.n_chars) for r in kept.collect()] == [(PROSE, len(PROSE))] * 2
    assert quality_rules.keep_clean(odd.where("false")).count() == 0 == quality_rules.assess(odd.where("false")).count()


def test_op8_sql(spark):
    from ..helpers import SMALL, oracle, rows_of

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows_of(quality_rules.assess(docs, with_text=False).drop("lost_chars").toPandas()) == rows_of(oracle(quality_rules.OP8_SQL))


# ---- classifier


def test_classifier_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality_model.train(docs, labels)
    scored = quality_model.score(docs, model).join(labels, "doc_id").where(quality_model.is_held_out("doc_id")).toPandas()
    good, bad = scored[scored.quality == 1], scored[scored.quality == 0]
    assert (good.predicted == 1).mean() > 0.98 and (bad.predicted == 0).mean() > 0.6
    assert (good.score.values[:, None] > bad.score.values).mean() > 0.97
    assert ((scored.score - scored.quality) ** 2).mean() < 0.03  # calibrated


def test_score_equals_brute_force(spark):
    import math

    import zstandard

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, labels)
    rows = {r.doc_id: r for r in quality_model.score(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert model.curve is not None and set(rows) == set(texts)

    def size(data, dictionary):
        made = zstandard.ZstdCompressor(level=model.level, write_checksum=False, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(dictionary))
        return len(made.compress(data))

    for i, text in texts.items():
        raw = text.encode()
        z = model.curve[0] + model.curve[1] * (size(raw, model.bad) - size(raw, model.good)) / (len(raw) + 1)
        want = 1 / (1 + math.exp(-max(-30, min(30, z)))) if raw else model.prior
        assert abs(rows[i].score - want) < 1e-12 and rows[i].predicted == (want >= 0.3)
    # the curve is that of least weighted log loss with a small penalty on its slope
    quality = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert model.prior == sum(quality.values()) / len(quality) and model.curve[1] > 0


def test_classifier_defined_cases(spark, odd):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality_model.train(odd, empty)
    assert model.prior == 0.5 and [r.score for r in quality_model.score(odd, model).collect()] == [0.5] * len(EDGE)
    few = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (4, 7, 0)], "doc_id bigint, quality int, toxic int")
    assert 0 <= quality_model.train(odd, few).prior <= 1
    texts = {1: [f"{PROSE} {i}".encode() for i in range(40)], 0: [f"x### y{i}*** z$$$ ".encode() * 9 for i in range(40)]}
    fitted = quality_model.fit(texts, {1: 40, 0: 40})
    f = fitted.scorer()
    assert f(PROSE) > 0.7 > 0.3 > f("q### r*** s$$$ " * 12) and f("") == f(None) == 0.5
    assert all(0 <= r.score <= 1 for r in quality_model.score(odd, fitted).collect())
    assert quality_model.keep_good(odd.where("false"), fitted).count() == 0 and quality_model.keep_good(odd, fitted).columns == odd.columns
    named = odd.selectExpr("*", "1 AS `a.b`", "2 AS score")
    assert quality_model.keep_good(named, fitted).columns == named.columns and quality_model.keep_good(named, fitted).count() == quality_model.keep_good(odd, fitted).count()


# ---- byte-level BPE


@pytest.fixture(scope="module")
def encoders():
    import tiktoken

    path, pattern = bpe.default_ranks()
    with open(path, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    return bpe.TextEncoder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(alphabet="ab", max_size=600), st.text(alphabet="theding ono\n", max_size=400), st.text(alphabet="é中ü0 ", max_size=300)))
def test_bpe_equals_the_library(encoders, text):
    own, library = encoders
    packed = own.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert own.decode(packed) == text.encode()


def test_bpe_long_pieces(encoders):
    own, library = encoders
    for text in ("a" * 30_011, "xyz" * 7_003, " " * 20_000, "thedinofon" * 3_000):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=120), st.binary(max_size=120))
def test_bpe_join_is_the_product(encoders, a, b):
    own = encoders[0].bpe
    assert own.join(own.reduce(a), own.reduce(b)) == own.direct(a + b)


def test_bpe_table(spark, odd, encoders):
    rows = bpe.round_trip_digest(odd).collect()
    for r, t in zip(rows, EDGE):
        ids = np.array(encoders[1].encode_ordinary(t or ""), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = bpe.decode_ids(bpe.encode_texts(odd)).collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for t in EDGE]
    assert bpe.round_trip_digest(odd.where("false")).count() == 0


# ---- packing


def test_ids_equal_the_library():
    ids = packing.Ids(packing.default_tokenizer())
    assert ids.fast is not None
    for t in EDGE + ["ẁeird ﷽ text ॐ ܐ", "naïve Ünïcode 日本"]:
        assert ids(t).tolist() == ids.library.encode(t or "", add_special_tokens=False).ids


@given(st.integers(1, 10_000), st.integers(1, 50))
def test_cuts(n, capacity):
    got = packing.cuts(n, capacity)
    assert sum(x for _, x in got) == n and all(0 < x <= capacity for _, x in got)
    assert all(x == capacity for _, x in got[1:]) and [s for s, _ in got] == list(np.cumsum([0] + [x for _, x in got])[:-1])


@settings(deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_sum_of_squares_rule(lengths):
    bins, offsets = packing.sum_of_squares(np.array(lengths, int), 40)
    level = {}
    for s, b, at in zip(lengths, bins.tolist(), offsets.tolist()):
        gaps = [40 - x for x in level.values() if x < 40]

        def cost(k, g, s=s, gaps=gaps):
            left = list(gaps)
            left.remove(g)
            left += [g - s] if g > s else []
            return sum(left.count(x) ** 2 for x in set(left))

        if b in level:
            assert cost(0, 40 - level[b]) == min(cost(0, g) for g in gaps if g >= s)
        else:
            assert not [g for g in gaps if g >= s]
        assert level.get(b, 0) == at
        level[b] = at + s
    assert max(level.values(), default=0) <= 40


def test_packing_table(spark, odd):
    rows = packing.packed_digest(odd.unionByName(odd)).toPandas()
    ids = packing.Ids(packing.default_tokenizer())
    for d, t in enumerate(EDGE[:-1]):
        own = np.append(ids(t), 0).astype("<u4")
        mine = rows[rows.doc_id == d].sort_values(["piece", "sequence_id"])
        for _, r in mine.iterrows():
            assert zlib.crc32(own[int(r.start) : int(r.start + r.length)].tobytes()) == r.ids_crc32
        assert mine.length.sum() == 2 * len(own)
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()]
    assert packing.packed_digest(odd.where("false")).count() == 0
    clash = packing.pack(spark.createDataFrame([(1, 0, 5, "x"), (2, 0, 7, "y")], "doc_id bigint, piece int, length bigint, offset string"))
    assert clash.columns[-2:] == ["sequence_id", "_offset"] and clash.count() == 2


def test_repeated_and_null_ids_are_dealt_to_all_groups(spark):
    rows = spark.range(5000).selectExpr("cast(null AS bigint) AS doc_id", "0 AS piece", "id % 90 + 10 AS length", "1 AS packed_row", "2 AS `x.y`")
    got = packing.pack(rows, capacity=100, group_pieces=100).toPandas()
    assert (got.sequence_id // 2**40).nunique() == 50 and len(got) == 5000 and list(got.columns[:5]) == rows.columns
    assert got.groupby("sequence_id").length.sum().max() <= 100


def test_packing_is_near_the_bound(spark):
    from ..helpers import SMALL

    rows = packing.op7(spark, SMALL.replace("0.001", "0.1")).toPandas()
    assert rows.sequence_id.nunique() <= 1.002 * -(-rows.length.sum() // 2048)


# ---- media


def test_netpbm_and_bmp():
    rng = np.random.default_rng(0)
    g, c = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (5, 7, 3), np.uint8)
    assert np.array_equal(media.decode_netpbm(media.encode_pgm(g)), g)
    assert np.array_equal(media.decode_netpbm(b"P6 # note\n7 5\n255\n" + c.tobytes()), c)
    assert np.array_equal(media.decode_netpbm(b"P2 7 5 255\n" + " ".join(map(str, g.ravel())).encode()), g)
    assert np.array_equal(media.decode_netpbm(b"P3 7 5 255\n" + " ".join(map(str, c.ravel())).encode()), c)
    bits = rng.integers(0, 2, (5, 11))
    assert np.array_equal(media.decode_netpbm(b"P4\n11 5\n" + np.packbits(bits, axis=1).tobytes()), 255 * (1 - bits))
    assert np.array_equal(media.decode_netpbm(b"P1\n11 5\n" + "".join(map(str, bits.ravel())).encode()), 255 * (1 - bits))
    wide = rng.integers(0, 60000, (5, 7)).astype(np.uint16)
    assert np.array_equal(media.decode_netpbm(b"P5 7 5 65535\n" + wide.astype(">u2").tobytes()), wide)
    assert np.array_equal(media.decode_bmp(media.encode_bmp(c)), c)
    for bad in (b"", b"P5", b"P5 2 2 255\nab", b"BM", b"P9 1 1 1", b"P6 # x", b"BM" + bytes(60), *damaged()):
        with pytest.raises(ValueError):
            media.decode_image(bad)


def paletted(depth, index, colors, used=0):
    h, w = index.shape
    row = {1: lambda r: np.packbits(r), 4: lambda r: np.array([(a << 4) | b for a, b in zip(*[iter([*r, 0][: (w + 1) // 2 * 2])] * 2)], np.uint8), 8: lambda r: r}[depth]
    body = b"".join((x := row(r.astype(np.uint8)).tobytes()) + bytes(-len(x) % 4) for r in index[::-1])
    table = b"".join(bytes((b, g, r, 0)) for r, g, b in colors)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 54 + len(table), 40, w, h, 1, depth, 0, len(body), 0, 0, used, 0) + table + body


def masked(depth, masks, samples):
    h, w = samples.shape
    body = b"".join((x := r.astype("<u2" if depth == 16 else "<u4").tobytes()) + bytes(-len(x) % 4) for r in samples)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 66, 40, w, -h, 1, depth, 3, len(body), 0, 0, 0, 0) + struct.pack("<III", *masks) + body


def damaged():
    short = paletted(8, np.full((2, 2), 5), [(1, 2, 3)] * 4, 4)
    return short, b"P2 1 1 255 " + b"9" * 40, b"P2 1 1 255 300", b"P2 2 1 255 1 x", b"P5 99999999999999999999 1 255\nx", masked(32, (0, 1, 2), np.zeros((1, 1))), masked(32, (5, 2, 8), np.zeros((1, 1)))


def test_ranges_palettes_and_masks():
    assert media.decode_netpbm(b"P2 3 1 15 0 7 15").tolist() == [[0, 119, 255]]
    assert media.decode_netpbm(b"P5 2 1 1\n\x00\x01").tolist() == [[0, 255]]
    wide = media.decode_netpbm(b"P5 2 1 1023\n" + np.array([0, 1023], ">u2").tobytes())
    assert wide.tolist() == [[0, 65535]] and wide.dtype == np.uint16
    deep = media.decode_netpbm(b"P5 16 16 65535\n" + np.arange(0, 65536, 256).astype(">u2").tobytes())
    small = media.area_resize(deep, 4, 4)
    assert small.dtype == np.uint16 and np.array_equal(small, np.rint(deep.reshape(4, 4, 4, 4).astype(float).mean((1, 3)))) and media.difference_hash(deep) != 0
    rng = np.random.default_rng(3)
    for depth in (1, 4, 8):
        colors = [tuple(int(v) for v in c) for c in rng.integers(0, 256, (1 << depth, 3))]
        index = rng.integers(0, 1 << depth, (3, 5))
        assert np.array_equal(media.decode_bmp(paletted(depth, index, colors)), np.array(colors, np.uint8)[index])
    five = rng.integers(0, 1 << 16, (2, 3))
    got = media.decode_bmp(masked(16, (0xF800, 0x7E0, 0x1F), five))
    assert np.array_equal(got[..., 1], [[round((v >> 5 & 63) * 255 / 63) for v in r] for r in five]) and np.array_equal(got[..., 2], [[round((v & 31) * 255 / 31) for v in r] for r in five])
    odd = rng.integers(0, 1 << 32, (2, 3))
    assert np.array_equal(media.decode_bmp(masked(32, (0xFF, 0xFF00, 0xFF0000), odd)), np.stack([odd & 255, odd >> 8 & 255, odd >> 16 & 255], -1))


def test_every_kind_reaches_the_store(spark):
    texts = [f"{k} " + "x" * (64 * 3 * (1 + k % 3) - len(f"{k} ")) for k in range(40)] + ["short"]
    stored = media.store_texts(frame(spark, texts))
    rows = stored.collect()
    assert {bytes(r.media[:2]) for r in rows} == {b"P5", b"P6", b"BM"}
    for r in media.describe(stored).collect():
        raw = texts[r.doc_id].encode()
        padded = raw + bytes(-len(raw) % 64)
        assert (r.payload_bytes, r.payload_sha256) == (len(padded), hashlib.sha256(padded).hexdigest())
        tile = np.load(io.BytesIO(r.tile))
        assert tile.shape[:2] == (32, 32) and r.feature.endswith(f":{zlib.crc32(r.tile):08x}")
    path = shared_path(spark, "tiles")
    kept = media.write_tiles(stored.selectExpr("*", "doc_id AS tile"), path, side=8)
    image = media.decode_image(bytes(rows[7].media))
    assert np.array_equal(np.load(io.BytesIO(kept.where(f"id = {rows[7].doc_id}").first().tile)), media.area_resize(image, 8, 8))
    pics = spark.createDataFrame([(k, x) for k, x in enumerate(damaged())], "i bigint, m binary")
    assert all(r.tile is None for r in media.decode_column(pics, "i", "m").collect())


def test_area_resize_keeps_the_mean_and_equals_brute_force():
    x = np.random.default_rng(1).integers(0, 256, (12, 18), np.uint8)
    assert np.array_equal(media.area_resize(x, 4, 6), np.rint(x.reshape(4, 3, 6, 3).mean((1, 3))).astype(np.uint8))
    fine = np.kron(x.astype(float), np.ones((5, 7))).reshape(5, 12, 7, 18).mean((1, 3))
    assert np.abs(media.area_resize(x, 5, 7) - fine).max() <= 0.5 + 1e-9
    out = io.BytesIO()
    np.save(out, x)
    assert out.getvalue() == media.npy_bytes(x)


def test_media_table(spark, odd):
    rows = media.describe(media.store_texts(odd)).collect()
    for r, t in zip(rows, EDGE):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert rows[4].asDict() | {"doc_id": 0} == rows[5].asDict() | {"doc_id": 0}
    pics = spark.createDataFrame([(1, media.encode_pgm(np.zeros((3, 3), np.uint8))), (2, b"x"), (3, None)], "i bigint, m binary")
    got = media.decode_column(pics, "i", "m", 4).collect()
    assert (got[0].height, got[0].dhash) == (3, "0" * 16) and got[1].tile is None and got[2].tile is None
    assert np.load(io.BytesIO(got[0].tile)).shape == (4, 4)


def test_vocabulary_is_read_not_copied():
    with open(packing.default_tokenizer(), "rb") as f:
        assert json.load(f)["model"]["type"] == "BPE"
    assert base64.b64decode(open(bpe.default_ranks()[0], "rb").readline().split()[0])
