"""The pipeline's stages against brute force, and the registered queries."""

import random
import re

import corpus_pipeline

from latticeq.llm import quality_rules, simhash
from latticeq.llm.queries import QUERIES

from ..helpers import SMALL


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
        if k < 4:
            assert docs.columns == columns
    raw = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    kept = [{r.doc_id: r.text for r in s.collect()} for s in seen[:4]]
    common = quality_rules.common_lines(spark.read.parquet(f"{SMALL}/documents.parquet"))
    judged = {i: quality_rules.judge(t, common=common) for i, t in raw.items()}
    assert kept[0] == {i: j["cleaned"] for i, j in judged.items() if j["kept"]}
    assert set(kept[1]) <= set(kept[0]) and set(kept[2]) <= set(kept[1]) and set(kept[3]) == set(kept[2])

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: grams(t) for i, t in kept[1].items()}
    alike = {i: [j for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    assert all(min(alike[i]) == i for i in kept[2] if len(alike[i]) == 1 or i == min(alike[i]))
    assert all(len([j for j in alike[i] if j in kept[2]]) <= 1 for i in sets)
    assert {i for i in sets if len(alike[i]) == 1} <= set(kept[2])
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9]", t) for t in kept[3].values())
    packed = seen[4].toPandas()
    assert set(packed.doc_id) == set(kept[3]) and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_scattered_copies_among_texts_that_share_a_passage(spark):
    rng = random.Random(3)

    def words(n):
        return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)]

    passage = words(172)
    texts = [passage + words(38) for _ in range(300)]
    for t in texts[:300:4]:
        copy = list(t)
        copy[-4], copy[-12], copy[-20], copy[-29] = words(4)
        texts.append(copy)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    least = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                old, new = sorted((least[i], least[j]), reverse=True)
                least = [new if x == old else x for x in least]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for most in (8, simhash.LIST_MOST):
        found = simhash.similar_documents(docs, list_most=most)
        assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(least))


def test_pairs_of_which_all_lists_are_long(spark):
    rng = random.Random(11)
    fresh = iter(range(10**6))

    def words(n):
        return [f"w{next(fresh)}x{rng.randrange(1000)}" for _ in range(n)]

    passage = words(184)
    own = [words(25) for _ in range(200)]
    for i in range(50, 56):
        own[i + 100][:3] = own[i][:3]  # of similarity 0.8 and more; all others are below
    texts = [passage + o for o in own]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    near = {(j, i) for j in range(200) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert near == {(i + 100, i) for i in range(50, 56)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for most in (8, simhash.LIST_MOST):
        found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, list_most=most).collect()}
        assert found == {i: i - 100 if (i, i - 100) in near else i for i in range(200)}


def test_large_part_with_strays(spark):
    rng = random.Random(5)

    def words(n):
        return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)]

    base = words(200)
    texts = [list(base) for _ in range(400)]
    for t in texts[1:]:
        for k in rng.sample(range(200), 6):
            t[k] = words(1)[0]
    texts += [base[:100] + words(100) for _ in range(5)] + [words(3), words(3), [], []]
    texts.append(texts[-4] + [])
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    least = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = sorted((least[i], least[j]), reverse=True)
                least = [new if x == old else x for x in least]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == dict(enumerate(least))


def test_stages_on_odd_tables(spark, tmp_path):
    from .test_text import PROSE

    words = PROSE.split()
    other = " ".join(words[::-1])
    rows = [
        (1, PROSE, "en", "s", len(PROSE)), (1, PROSE, "en", "s", len(PROSE)), (1, other, "en", "s", 0), (2, PROSE, None, None, None), (None, PROSE, "en", "s", 1), (None, None, None, None, None),
        (3, None, "en", "s", None), (4, "", "en", "s", 0), (5, " \n\t", "en", "s", 3), (6, "x " * 100_000, "en", "s", 1), (7, f"{other} mail a@b.org now", "en", "s", 2), (8, " ".join(f"w{k % 9973} v{k % 7919}" for k in range(60_000)), "en", "s", 3),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 AS rank", "2 AS kept_id", "3 AS `a.b`", "4 AS c1", "5 AS pii_key", "6 AS length", "7 AS tid")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (9, None, None)], "doc_id bigint, quality int, toxic int")
    for name, some in (("odd", docs), ("none", docs.where("false"))):
        sf_dir = str(tmp_path / name)
        some.write.parquet(f"{sf_dir}/documents.parquet")
        labels.write.parquet(f"{sf_dir}/labels.parquet")
        now = spark.read.parquet(f"{sf_dir}/documents.parquet")
        kept = []
        for k, (stage, work) in enumerate(corpus_pipeline.STAGES):
            work(spark, now, sf_dir).write.parquet(f"{sf_dir}/{k}")
            now = spark.read.parquet(f"{sf_dir}/{k}")
            assert k == 4 or now.columns == some.columns
            kept.append(sorted((r.doc_id or 0, (getattr(r, "text", "") or "")[-12:]) for r in now.collect()))
        if name == "none":
            assert kept == [[]] * 5
            continue
        assert [i for i, _ in kept[0]] == [0, 1, 1, 1, 2, 7, 8] and kept[1] == kept[0]
        assert kept[2] == sorted([(0, PROSE[-12:]), (1, PROSE[-12:]), (1, other[-12:]), (8, kept[0][-1][1])])  # 7 is near the other text of 1
        assert kept[3] == kept[2] and {i for i, _ in kept[4]} == {0, 1, 8}


def test_run_and_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_library_does_not_import_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2] / "latticeq"
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"import.*\bllm\b|\bllm\b.*import", file.read_text()), file
