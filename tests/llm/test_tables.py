"""Near-duplicates, personal data, chat, shards and archives against brute force."""

import collections
import gzip
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticeq.llm import chat, pii, sharding, simhash, warc
from latticeq.llm.common import shared_path

from .test_text import DOCS, EDGE, PROSE, frame, odd  # noqa: F401

# ---- SimHash


def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def brute_components(prints):
    """Smallest id reachable over at most two differing bits; ``prints`` is a list of (id, fingerprint)."""
    todo, out = dict(sorted(prints)), {}
    for i in list(todo):
        if i in out:
            continue
        front = [i]
        out[i] = i
        while front:
            x = front.pop()
            for j in todo:
                if j not in out and bin((todo[x] ^ todo[j]) & (2**64 - 1)).count("1") <= 2:
                    out[j] = i
                    front.append(j)
    return out


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="ab AÉ\t\n", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_text_fingerprint(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


@pytest.mark.parametrize("list_most", [2, 64])
def test_links_short_and_long_lists_lose_none(spark, list_most):
    rng = np.random.default_rng(7)
    centers = [int(x) for x in rng.integers(0, 2**63, 6)] + [0, 2**64 - 1]
    prints = {}
    for i in range(260):
        bits = rng.choice(64, int(rng.integers(0, 5)), replace=False)
        prints[i] = centers[i % 8] ^ sum(1 << int(b) for b in bits)
    by_print = {}
    for i, p in prints.items():
        by_print.setdefault(p, i)
    rows = [(p - 2**64 if p >> 63 else p, i) for p, i in by_print.items()]
    df = spark.createDataFrame(rows, "fp bigint, node bigint")
    tally = {(r.a, r.b): r.lists for r in simhash.tallied(df, list_most).collect()}
    pairs = {(min(p, q), max(p, q)): p ^ q for p, _ in rows for q, _ in rows if p != q}
    shared = {k: sum((x >> 8 * p) & 255 == 0 for p in range(8)) for k, x in pairs.items()}
    for k, x in pairs.items():
        if bin(x & (2**64 - 1)).count("1") <= 2 or list_most == 64 and shared[k] >= 5:
            assert tally[k] == math.comb(shared[k], 5)
    assert all(tally[k] <= math.comb(shared[k], 5) for k in tally)
    got = {(r.a, r.b) for r in simhash.links(df, list_most).collect()}
    assert got == {k for k, x in pairs.items() if bin(x & (2**64 - 1)).count("1") <= 2}


def test_one_large_ball_of_fingerprints(spark):
    center = 0x0123456789ABCDEF
    prints = [center] + [center ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)] + [center ^ (1 << i) for i in range(64)]
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp bigint")
    found = {(r.a, r.b) for r in simhash.links(df).collect()}
    signed = [r.fp for r in df.collect()]
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_near_duplicates_defined_cases(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(EDGE)
    for r, t in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id)), EDGE):
        assert r.fp & (2**64 - 1) == brute_fingerprint(t)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id in (0, 1, 2, 4, 5)} == {0: 0, 1: 0, 2: 0, 4: 4, 5: 4}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    twice = odd.unionByName(odd)
    assert simhash.near_duplicates(twice).count() == 2 * len(EDGE)
    assert simhash.near_duplicates(odd.where("false")).count() == 0 == simhash.keep_one(odd.where("false")).count()


def test_keep_one_catches_near_copies_and_leaves_others(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    texts, groups = [], []
    for g in range(12):
        base = rng.choice(words, 200).tolist()
        for k in range(6):
            copy = list(base)
            if k:
                copy[int(rng.integers(5, 190))] = f"new{g}x{k}"
            texts.append(" ".join(copy).upper() if k == 1 else " ".join(copy))
            groups.append(g)
    far = rng.choice(words, 200).tolist()
    half = far[:120] + rng.choice(words, 80).tolist()
    texts += [" ".join(far), " ".join(half)]
    docs = frame(spark, texts).selectExpr("*", "doc_id AS rank", "text AS node")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [g * 6 for g in range(12)] + [72, 73]
    assert sorted(r.doc_id for r in simhash.keep_one(docs.unionByName(docs)).collect()) == [g * 6 for g in range(12)] + [72, 73]


def test_similarity_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    seen, links, wrong = set(), 0, 0
    for own in holders.values():
        for a in own:
            for b in own:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                        links += 1
                        wrong += found[a] != found[b]
    assert links > 50 and wrong == 0


def test_long_lists_of_similar_texts(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base[:k] + [f"z{k}"] + base[k + 1 :]) for k in range(0, 300, 2)] + [PROSE]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(frame(spark, texts)).collect()}
    assert set(found.values()) == {0, 150}


# ---- personal data

BRUTE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m.group())] for k, (p, ok) in BRUTE.items()}


def test_base_spans_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    parts = ["a@b.c", "_d@e.f", "x@y", "@", "1.2.3.4", "256.1.1.1", "01.002.3.4", ".5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "0", "00", "7 ", "-3", "+1 (499) 555-6503", "+", "+4 ", "(", ")", " ", ".", "é", "𝄞", "123456789", "4111111111111111", "\n", "%", "a.b-c@d-e.f.g."]
    texts = ["".join(rng.choice(parts, int(rng.integers(1, 14)))) for _ in range(1500)] + EDGE + ["1" * 100_000, "1 " * 50_000, "a" * 100_000 + "@", "1.2.3.4 " * 2_000, "a@b." + "c." * 20_000, "+1" * 20_000, "a@" * 20_000]
    rows = pii.find(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert {k: [(s.start, s.end) for s in r[k]] for k in pii.KINDS} == brute_spans(texts[r.doc_id]), texts[r.doc_id][:200]


def test_bootstrapping_finds_what_seeds_vouch_for(spark):
    cards = [f"41111111111111{k:02d}" for k in range(100)]
    good = [c for c in cards if BRUTE["card"][1](c)]
    bad = [c for c in cards if c not in good][:3]
    texts = [f"{PROSE} paid with {c} today" for c in good] + [f"{PROSE} paid with {c} today" for c in bad] + [f'{PROSE} token = "{k:040x}" end' for k in (10**40, 7**47)] + [f"{PROSE} version 20240101 of things", PROSE]
    rows = {r.doc_id: r for r in pii.find(frame(spark, texts)).collect()}
    n = len(good)
    assert all(len(rows[i].card) == 1 and not rows[i].extra for i in range(n))
    assert all([s.kind for s in rows[i].extra] == ["found"] for i in range(n, n + len(bad)))
    assert all([s.kind for s in rows[i].extra] == ["secret"] for i in (n + len(bad), n + len(bad) + 1))
    assert not rows[len(texts) - 2].extra and not rows[len(texts) - 1].extra


def brute_words(text):
    """Identifier-like words by plain scanning: letters, digits, underscores, single separators between them."""
    out, at, n = [], 0, len(text)

    def plain(c):
        return c.isascii() and (c.isalnum() or c == "_")

    while at < n:
        if not plain(text[at]):
            at += 1
            continue
        end = at
        while end < n and (plain(text[end]) or text[end] in "-.:/" and end + 1 < n and plain(text[end + 1]) and plain(text[end - 1])):
            end += 1
        if end - at >= 8 and sum(c.isdigit() for c in text[at:end]) >= 4:
            out.append((at, end))
        at = end
    return out


def test_words_of_any_length_and_with_separators(spark):
    rng = np.random.default_rng(4)
    parts = ["123-45-6789", "ab", "12", "_", "-", ".", "--", " ", "x" * 70, "9" * 80, "é", "/", ":", "A1b2", "\n", '"']
    texts = ["".join(rng.choice(parts, int(rng.integers(1, 12)))) for _ in range(800)] + ["a-" * 50_000, "a--" * 50_000, "1-" * 50_000, "a" * 200_000, "a" * 200_000 + "1234", "token = \"" + "k1" * 4_000 + '"']
    for r in pii.scan(frame(spark, texts)).select("doc_id", "others").collect():
        assert [(s.start, s.end) for s in r.others] == brute_words(texts[r.doc_id]), texts[r.doc_id][:99]
    found = pii.find(frame(spark, ['x token = "' + "a1" * 40 + '" y', "password: 123-45-6789."])).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r.extra] for r in found] == [[("secret", 11, 91)], [("secret", 10, 21)]]


def brute_scores(rows):
    """Strings that patterns vouch for; ``rows`` are (string, seed, patterns)."""
    edges = {(p, s) for s, _, ps in rows for p in ps}
    seeds = {s: max(float(k) for t, k, _ in rows if t == s) for s, _, _ in rows}
    seed_edges = {(p, s) for s, k, ps in rows if k for p in ps}
    sure, strong, was = dict(seeds), dict.fromkeys(seeds, False), {}
    while True:
        trust, count = {}, {}
        for p in {p for p, _ in edges}:
            own = [s for q, s in edges if q == p]
            value, n = sum(sure[s] for s in own) / (len(own) + 2.0), sum((p, s) in seed_edges for s in own)
            if value > 0.05 and n >= 1:
                trust[p], count[p] = value, n
        if max((v - was.get(p, 0.0) for p, v in trust.items()), default=0.0) <= 0.005:
            return {s for s in seeds if not seeds[s] and strong[s] and sure[s] >= 0.7}
        was = trust
        for s in seeds:
            mine = [p for p, t in edges if t == s and p in trust]
            sure[s] = max(seeds[s], 0.99 * (1 - math.prod(1 - min(trust[p], 0.999) for p in mine)))
            strong[s] = any(trust[p] >= 0.7 and count[p] >= 5 for p in mine)


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    sizes = []
    for turn in range(3):
        rows = []
        for k in range(160):
            own = int(rng.integers(0, 90))
            patterns = [f"L:{own % 7 if rng.random() < 0.8 else rng.integers(0, 12)}", f"S:{own % 4}"]
            rows.append((own, bool(own % 7 < 3 + turn and own % 5), patterns))
        df = spark.createDataFrame([(s, "card" if k else None, p) for s, k, p in rows], "instance bigint, kind string, patterns array<string>")
        want = brute_scores(rows)
        assert {r.instance for r in pii.score_graph(df).collect()} == want
        sizes.append(len(want))
    assert max(sizes) > 0
    assert pii.score_graph(df.where("false")).count() == 0


def test_redact(spark, odd):
    texts = ["mail a@b.c, call +1 (499) 555-6503 é", 'x token = "0123456789abcdef0123" y', PROSE, "1.2.3.4@h.io and 1.2.3.4"]
    docs = frame(spark, texts).unionByName(odd).selectExpr("*", "doc_id AS key", "text AS extra", "1 AS pii_key", "2 AS __id", "3 AS `a.b`")
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r.extra: r.text for r in out.collect()}
    assert got[texts[0]] == "mail [EMAIL], call [PHONE] é" and got[texts[1]] == 'x token = "[SECRET]" y' and got[PROSE] == PROSE and got[texts[3]] == "[EMAIL] and [IP]"
    assert all(r.n_chars == len(r.text) for r in out.where("text IS NOT NULL").collect())
    assert pii.redact(odd.where("false")).count() == 0 == pii.find(odd.where("false")).count()
    assert pii.redact(docs.unionByName(docs)).count() == 2 * docs.count()


# ---- chat

TALK = "conv_id bigint, turn bigint, role string, text string"


def test_chat_round_trip(spark):
    nasty = ["", None, "␛", "␛0␛1␛2", "<|im_end|>\n", "<<|im_start|>user\nx", "</s>[INST] ok [/INST]", "<s><SYS>>|<|", "a\n\nb", "x" * 100_000, "␛1|<␛1|"]
    roles = ["user", "assistant", "us\ner", "<|im_start|>", None, "system", "tool"]
    rows = [(c, t, roles[(c + t) % len(roles)], nasty[(c * 3 + t) % len(nasty)]) for c in range(40) for t in range(c % 6 + 1)] + [(None, None, "user", "q"), (None, 1, "assistant", "a")]
    talks = chat.format_conversations(spark.createDataFrame(rows, TALK).selectExpr("*", "role AS state", "text AS segments"))
    read = talks.select("conv_id", chat.read_back(chat.formatted(F.col("segments"))).alias("turns"), chat.loss_text(F.col("segments")).alias("learned"), chat.formatted(F.col("segments")).alias("f")).collect()
    want = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want[c].append((r or "", x or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in read} == want
    for r in read:
        assert r.learned == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert r.f.count("<|im_start|>") == len(want[r.conv_id]) and "</s>" not in r.f and "[INST]" not in r.f
    assert chat.format_conversations(spark.createDataFrame([], TALK)).count() == 0


def test_chat_machine(spark):
    orders = {1: "system user assistant", 2: "user assistant user", 3: "user user", 4: "assistant", 5: "user assistant tool tool assistant", 6: "user other assistant"}
    rows = [(c, t, r, "x") for c, o in orders.items() for t, r in enumerate(o.split())]
    got = {r.conv_id: (r.valid, r.violation) for r in chat.format_conversations(spark.createDataFrame(rows, TALK)).collect()}
    assert got == {1: (True, None), 2: (False, None), 3: (False, 1), 4: (False, 0), 5: (True, None), 6: (False, 1)}


def test_loss_flags_come_from_the_moves(spark):
    rows = [(1, t, r, f"x{t}") for t, r in enumerate("system user assistant tool assistant assistant user critic".split())]
    df = spark.createDataFrame(rows, TALK)
    flags = [s.loss for s in chat.format_conversations(df).first().segments[1::3]]
    assert flags == [False, False, True, False, True, True, False, False]
    moves = chat.Template().moves | {("user", "assistant"): ("assistant", False), ("user", "critic"): ("user", True)}
    own = chat.format_conversations(df, chat.Template(moves=moves, stray=())).first()
    assert [s.loss for s in own.segments[1::3]] == [False, False, False, False, True, False, False, True] and own.violation == 5


def test_op3_sql(spark):
    from ..helpers import SMALL, oracle, rows_of

    assert rows_of(chat.op3(spark, SMALL).toPandas()) == rows_of(oracle(chat.OP3_SQL))


# ---- shards


@given(st.lists(st.integers(0, 30), min_size=1, max_size=6), st.integers(1, 5), st.integers(0, 99))
def test_matrix_margins(counts, shards, seed):
    n = sum(counts)
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    m = np.array(sharding.communication_matrix(counts, sizes, seed)).reshape(len(counts), shards)
    assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes and (m >= 0).all()


def test_matrix_law():
    got = collections.Counter(sharding.communication_matrix([2, 2], [2, 2], s)[0][0] for s in range(6000))
    assert abs(got[1] / 6000 - 4 / 6) < 0.03 and abs(got[0] / 6000 - 1 / 6) < 0.03
    rng = np.random.default_rng(0)
    from math import lgamma

    def log_p(k, good=600_000_000, bad=500_000_000, draws=7):
        def choose(a, b):
            return lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)

        return choose(good, k) + choose(bad, draws - k) - choose(good + bad, draws)

    seen = collections.Counter(sharding.draw_one(600_000_000, 500_000_000, 7, rng) for _ in range(20_000))
    assert all(abs(seen[k] / 20_000 - np.exp(log_p(k))) < 0.02 for k in range(8))
    assert sharding.draw_one(5, 2 * 10**9, 2 * 10**9 + 5, rng) == 5 and sharding.draw_one(2 * 10**9, 0, 7, rng) == 7
    big = [sharding.draw_one(3 * 10**9, 10**9, 4000, rng) for _ in range(50)]
    assert abs(np.mean(big) - 3000) < 30 and all(0 <= x <= 4000 for x in big)


def test_shards(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.sharded_digest(docs).toPandas()
    assert rows.groupby("shard").size().isin([41, 42]).all() and rows["shard"].nunique() == 24
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    raw = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(raw[r.doc_id]) and r["size"] == len(raw[r.doc_id]) + 8 for _, r in rows.iterrows())
    again = sharding.sharded_digest(docs.repartition(7)).toPandas()
    assert rows.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    assert abs(np.corrcoef(rows.doc_id, rows["slot"])[0, 1]) < 0.15
    more = sharding.shuffle_into_shards(odd.unionByName(odd).selectExpr("*", "doc_id AS size"), 5, blocks=3).toPandas()
    assert len(more) == 2 * len(EDGE) and all(sorted(g.slot) == list(range(len(g))) for _, g in more.groupby("shard"))
    assert sharding.sharded_digest(odd.where("false")).count() == 0
    clash = sharding.shuffle_into_shards(odd.selectExpr("doc_id", "1 AS shard", "2 AS slot"), 3)
    assert clash.columns == ["doc_id", "shard", "slot", "_shard", "_slot"] and clash.count() == len(EDGE)


def test_shards_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 16)
    df = spark.range(700).selectExpr("id", "id AS block", "1 AS shuffle_key", "2 AS `a.b`", "3 AS __block", "4 AS bounds")
    got = sharding.shuffle_into_shards(df, 5, seed=9)
    assert got.columns == [*df.columns, "shard", "slot"]
    keys = {r.id: r for r in df.select("id", *(F.xxhash64(F.lit(9), F.lit(k), *(F.col(f"`{c}`") for c in df.columns)).alias(f"k{k}") for k in (1, 2, 3))).collect()}
    blocks = -(-700 // 16)

    def order(ids, k):
        return sorted(ids, key=lambda i: (keys[i][k] & (2**64 - 1)))

    held = [[i for i in range(700) if keys[i].k1 % blocks == b] for b in range(blocks)]
    matrix = sharding.communication_matrix([len(h) for h in held], [140] * 5, 9)
    shards = [[] for _ in range(5)]
    for own, row in zip(held, matrix):
        at = 0
        ordered = order(own, "k2") if sharding._bits(max(map(len, held))) else sorted(own, key=lambda i: keys[i].k2)
        for s, n in enumerate(row):
            shards[s] += ordered[at : at + n]
            at += n
    want = {i: (s, k) for s, own in enumerate(shards) for k, i in enumerate(order(own, "k3"))}
    assert {r.id: (r.shard, r.slot) for r in got.collect()} == want


# ---- archives


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_framing(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload


def test_broken_records():
    for bad in (b"5\r\nab", b"zz\r\n", b"", b"2\r\nabX\r\n0\r\n\r\n"):
        with pytest.raises(warc.Fault):
            warc.dechunked(bad)
    parts = [(2, b"b", 2), (1, b"a", None)]
    assert warc.reassemble(parts) == b"ab"
    for broken in ([(1, b"a", None)], [(1, b"a", 3), (2, b"b", 3)], [(1, b"a", None), (3, b"b", 2)], [(1, b"a", None), (1, b"b", 2)]):
        with pytest.raises(warc.Fault):
            warc.reassemble(broken)
    assert [f for _, _, f in warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")] == ["record is cut short"]


def test_damaged_files_are_reported_and_the_rest_is_read(spark, tmp_path):
    def page(i, text=b"hello"):
        return b"".join(r + warc.END for r in warc.records(i, "http://h", text, hashlib.sha1(text).hexdigest(), None, "2024-01-01T00:00:00Z", 400))

    long = b"".join(b"%d " % k for k in range(300))
    files = {
        "a.warc": page(1) + page(2)[:-9] + page(3) + page(4, long),
        "b.warc.gz": gzip.compress(page(5)) + gzip.compress(page(6)),
        "c.warc.gz": gzip.compress(page(7) + page(8))[:-30],
        "d.warc": page(9).replace(b"Content-Length: ", b"Content-Size: ") + page(10),
        "e.warc": page(11).replace(b"WARC-Payload-Digest", b"X-Other") + page(12).replace(hashlib.sha1(b"hello").hexdigest().encode(), b"0" * 40) + page(13).replace(b"X-Page-Id: 13", b"X-Page-Id: many"),
        "f.warc": b"garbage", "g.warc": b"", "h.warc.gz": b"\x1f\x8bjunk",
        "i.warc": page(14, long).split(warc.END + b"WARC", 2)[0] + warc.END,
        "j.warc": next(warc.records(15, "u", b"x" * 2000, "0" * 40, 99, "2024-01-01T00:00:00Z")) + warc.END,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    sound = {r.page_id: bytes(r.payload) for r in rows if r.fault is None and r.record_type == "response"}
    assert {1, 3, 4, 5, 6, 10, 11} <= set(sound) and sound[4] == long and not {2, 8, 9, 12, 13, 14} & set(sound)
    faults = collections.Counter(r.fault for r in rows if r.fault)
    for told in ("record is cut short", "content length is missing", "digest differs", "page id is no number", "no record where one is due", "total length differs"):
        assert faults[told] >= 1, (told, faults)
    assert sum(n for f, n in faults.items() if f.startswith("gzip")) == 2 and all(r.payload is None for r in rows if r.fault)
    told = warc.resolve(warc.read_archives(spark, str(tmp_path))).collect()
    assert sum(r.fault is not None for r in told) == sum(faults.values()) + 1 and [r.fault for r in told if r.page_id == 15] == ["its response is missing"]


def test_archives_round_trip(spark):
    pages = [(i, f"http://h/{i}", x) for i, x in enumerate(["", None, "short", "short", "é" * 600, "é" * 600, "\r\n\r\nWARC/1.1\r\n\r\n" * 5000, "z" * 150_000, "z" * 150_000, "z" * 150_000])] + [(None, None, "n" * 2000), (99, "u r\nl", "n" * 2000), (7, "http://h/7", "z" * 150_000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "url AS digest", "page_id AS size")
    path = shared_path(spark, "warc-test")
    warc.write_archives(df, path, segment=4096)
    found = warc.read_archives(spark, path)
    rows = found.collect()
    assert all(r.fault is None for r in rows) and len(rows) == len(pages)
    assert sorted((str(r.page_id), bytes(r.payload)) for r in rows if r.record_type == "response") == sorted((str(i), (x or "").encode()) for i, _, x in pages if i in (0, 1, 2, 3, 5, 6, 9, 99))
    told = {r.page_id: r for r in warc.resolve(found).collect()}
    for i, _, x in pages:
        raw = (x or "").encode()
        owner = max((j for j, _, y in pages if y == x and j is not None), default=None) if len(raw) >= 1000 else None
        revisit = owner is not None and owner != i
        r = told[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", owner if revisit else None)


def test_op6_sql(spark):
    from ..helpers import SMALL, oracle, rows_of

    assert rows_of(warc.op6(spark, SMALL).toPandas()) == rows_of(oracle(warc.OP6_SQL))
