import numpy as np
from pyspark.sql import functions as F

from latticeq.operators import benchmark, reports, specs


def test_protocols_of_planted_vectors(spark):
    n = 6
    designs = spark.range(n).select(F.col("id").alias("label"))
    spec = specs.build(designs, spark.createDataFrame([(2, "x")], "label bigint, photo string"))
    pairs = specs.pairs(designs)
    rows = []
    for r in spec.collect():
        v = np.full(n, 0.01)
        v[r.label] = 1.0
        if r.role == "trap":  # traps look like their donors
            v[r.donor_label], v[r.label] = 1.0, 0.5
        rows.append((r.spec_id, (v / np.linalg.norm(v)).tolist()))
    vectors = spark.createDataFrame(rows, "spec_id bigint, embedding array<double>")
    found = benchmark.protocols(spec, pairs, vectors, tau=0.5)
    got = {(r.protocol, r.family, r.metric): r.value for r in found.collect()}
    assert got["P1", "all", "r1"] == 1.0 and got["P1", "all", "n_queries"] == 8 * n and got["P1", "heldout", "n_queries"] == 2 * n
    assert got["P1", "all", "r10"] is None or got["P1", "all", "r10"] == 1.0
    assert got["P2", "trap", "trap1"] == 1.0 and got["P2", "trap", "r1"] == 0.0 and got["P2", "trap", "r5"] == 1.0
    assert got["P3", "shared", "r1"] == 1.0 and got["P3", "shared", "n_queries"] == n and got["P4", "rephoto", "n_queries"] == 1
    assert got["verification", "all", "auc"] == 1.0 and got["verification", "all", "eer"] == 0.0 and got["verification", "all", "acc"] == 1.0
    assert got["verification", "all", "n_genuine"] == 2 * n and got["verification", "all", "n_impostor"] == 4 * n
    assert got["scores", "genuine", "mean"] > 0.99
    head = benchmark.headline(found)
    row = head.first()
    assert row.p1_r1 == 1.0 and row.p2_trap1 == 1.0 and row.p4_r1 == 1.0
    assert abs(benchmark.selection_score(head).first().val_score - 2 / 3) < 1e-9
    text = reports.markdown(reports.side_by_side({"a": head, "b": head}))
    assert text.count("\n") == 3 and "| a | 1.000 |" in text
    tau, test = benchmark.calibrated((spec, pairs, vectors), (spec, pairs, vectors))
    assert 0.5 < tau <= 1.0 + 1e-9 and test.count() == found.count()


def test_reports(spark, tmp_path):
    assert reports.model_name("/runs/ours/best.pt") == "ours" and reports.model_name(None, "x", True) == "zeroshot_x_gray"
    (tmp_path / "a.PNG").write_bytes(b"")
    assert reports.discover_roots(f"{tmp_path}/**", depth=len(str(tmp_path).split("/")) - 1) == [str(tmp_path)]
    assert reports.latency(lambda: None, 3, 1) >= 0
    m = spark.createDataFrame([("p", "s", 0, "train"), ("q", "s", 0, "train"), ("r", "t", 1, "test")], "path string, source string, group int, split string")
    assert tuple(reports.catalog_summary(m).first()) == (3, 2, 1)
    assert {tuple(r) for r in reports.source_by_split(m).collect()} == {("s", 2, 0, 0), ("t", 0, 0, 1)}


def test_evaluate_from_a_manifest(spark, tmp_path, capsys):
    from latticeq import __main__ as cli
    from latticeq.sources import files

    from .helpers import png
    from .test_images import pattern

    for k in range(24):
        png(tmp_path / "in" / f"p{k}.png", pattern(200 + k, 96, 110))
    png(tmp_path / "in" / "p0_again.png", np.clip(pattern(200, 96, 110).astype(int) + 2, 0, 255).astype(np.uint8))
    out = str(tmp_path / "work")
    cli.main(["prepare", "--roots", str(tmp_path / "in"), "--out", out])
    manifest = files.read_manifest(spark, f"{out}/manifest").collect()
    assert len(manifest) == 25 and all(r.path.startswith(f"{out}/cache/") for r in manifest)
    assert {r.path for r in files.read_cache(spark, f"{out}/cache").collect()} == {r.path for r in manifest}
    # every group is in validation or test, so that both have three designs at least
    rows = spark.createDataFrame([(k, r.path, r.source, r.path, r.group, "val" if r.group % 2 else "test") for k, r in enumerate(manifest)], "pos bigint, path string, source string, orig string, group bigint, split string")
    files.write_manifest(rows, f"{out}/sides")
    capsys.readouterr()
    cli.main(["evaluate", "--manifest", f"{out}/sides", "--cache", f"{out}/cache", "--size", "32", "--out", f"{out}/result", "--gray"])
    found = files.read_document(spark, f"{out}/result")
    assert set(found) == {"model", "split", "val_threshold", "headline", "full"} and found["model"] == "zeroshot_thumbnail_gray" and found["split"] == "test"
    head = found["headline"]
    assert 0 <= head["p1_r1"] <= 1 and head["acc"] is not None and head["p4_r1"] == 1.0 and found["full"]["verification"]["all"]["n_genuine"] == 24
    assert '"p1_r1"' in capsys.readouterr().out
    cli.main(["efficiency", "--size", "32", "--out", f"{out}/speed"])
    speed = files.read_document(spark, f"{out}/speed")
    assert speed["embedding_dim"] == 64 and speed["latency_ms_bs1"] > 0 and speed["embedding_bytes_fp16"] == 128
