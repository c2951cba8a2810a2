import json

import pytest
from pyspark.sql import functions as F

from quaymark.sources import results as S


@pytest.fixture
def folder(tmp_path):
    def put(name, model, split="test", demo=False, score=1.0, broken=False):
        p = tmp_path / "in" / model / name
        p.parent.mkdir(parents=True, exist_ok=True)
        body = json.dumps({"model_name": model, "dataset_name": "d", "split": split, "demo": demo, "records": [{"index": 1, "prompt": "q", "score": score, "cost": 0.5}, {"index": 2}]})
        p.write_text(body[:-20] if broken else body)

    put("d_20250101_000000.json", "a", score=0.1)
    put("d_20250301_120000.json", "a", score=0.9)
    put("d_20250201_000000.json", "b")
    put("d_20250202_000000.json", "b", demo=True)
    put("d_20250203_000000.json", "c", broken=True)
    return str(tmp_path / "in")


def test_result_files(spark, folder):
    files = S.read_results(spark, folder)
    kept = S.latest_files(S.select_files(files))
    assert {(r["model_name"], r["stamp"]) for r in kept.collect()} == {("a", 20250301120000), ("b", 20250201000000)}
    rows = {(r["model_name"], r["record_index"]): r for r in S.records(kept).collect()}
    assert rows[("a", 1)]["score"] == 0.9 and rows[("a", 2)]["score"] == 0.0 and rows[("a", 2)]["prompt"] == ""
    assert S.select_files(files, only={"model_name": ["a"]}, without={"model_name": ["a"]}).count() == 2
    assert S.select_files(files, without={"model_name": ["a"]}).count() == 1
    S.require(kept, "model_name", ["a"])
    with pytest.raises(ValueError):
        S.require(kept, "model_name", ["a", "z"])
    with pytest.raises(ValueError):
        S.no_overlap(["a"], ["a", "b"])


def test_append_log(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"id": "x", "v": 1}\nnot json\n{"id": "y", "v": 2}\n{"id": "x", "v": 3}\n')
    assert {r["id"]: r["v"] for r in S.read_log(spark, str(p), "id string, v int", "id").collect()} == {"x": 3, "y": 2}


def test_event_stream(spark):
    body = 'event: a\ndata: {"usage": {"input_tokens": 7}}\n\ndata: {"usageMetadata": {"promptTokenCount": 5}}\r\n\r\nevent: end\n\n'
    rows = spark.createDataFrame([(body,)], "b string").select(F.explode(S.split_events(F.col("b"))).alias("e")).select(S.event_data(F.col("e")).alias("d")).select("d", S.usage_tokens(F.col("d")).alias("n")).collect()
    assert [r["n"] for r in rows] == [7, 5, None]


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") % 3)
    S.write_new(df, str(tmp_path / "t"), ["v"])
    with pytest.raises(Exception, match="(?i)exist"):
        S.write_new(df, str(tmp_path / "t"))
    a = S.fingerprint(df, ["id", "v"])
    assert a == S.fingerprint(spark.read.parquet(str(tmp_path / "t")).orderBy(F.desc("id")), ["id", "v"]) != S.fingerprint(df.where("id > 0"), ["id", "v"])
    assert S.report(df.orderBy("id"), ["id"], 1) == "| id |\n| - |\n| 0 |\n\n9 more rows"
    assert S.report(df.where("id = 0"), ["id"], 1) == "| id |\n| - |\n| 0 |"


def test_posteriors(spark):
    text = json.dumps({"posterior": {"0": {"a": {"mean": 0.5, "variance": 0.1}}, "1": {"b": {"mean": 0.2, "variance": 0.3}}}})
    assert {(r["cluster_id"], r["model_name"], r["mean"]) for r in S.posteriors(spark, text).collect()} == {("0", "a", 0.5), ("1", "b", 0.2)}
    with pytest.raises(ValueError):
        S.posteriors(spark, text.replace("0.1", "-0.1"))


def test_binary_vectors_and_bundles(spark, tmp_path):
    import numpy as np

    from quaymark.sources import files as Z

    x = np.arange(12, dtype="<f4").reshape(4, 3)
    head = json.dumps({"n": 4, "embed_dim": 3, "corpus_sha256": "abc"}).encode()
    (tmp_path / "v.bin").write_bytes(b"PEM1" + len(head).to_bytes(4, "little") + head + x.tobytes())
    assert [list(r["vec"]) for r in Z.read_vectors(spark, str(tmp_path / "v.bin"), "abc").orderBy("place").collect()] == x.tolist()
    for bad in (lambda: Z.read_vectors(spark, str(tmp_path / "v.bin"), "other"),):
        with pytest.raises(Exception, match="another text"):
            bad().collect()
    b = tmp_path / "bundles" / "v1"
    b.mkdir(parents=True)
    (b / "centroids.bin").write_bytes(b"CRTS" + np.array([1, 2, 3], "<u4").tobytes() + x[:2].tobytes())
    (b / "quality_means.json").write_text(json.dumps({"0": {"m": 0.5}, "1": {"m": 0.25}}))
    (b / "model_axes.json").write_text(json.dumps({"axes": {"m": {"tps": 3.0}}}))
    (tmp_path / "bundles" / "latest").write_text("v1")
    bundle = Z.read_bundle(spark, str(tmp_path / "bundles"), dim=3)
    assert {(r["cluster_id"], r["mean"]) for r in bundle.quality.collect()} == {(0, 0.5), (1, 0.25)} and bundle.axes.first()["tps"] == 3.0
    with pytest.raises(ValueError, match="dimensions"):
        Z.read_bundle(spark, str(tmp_path / "bundles"), dim=4)
    (b / "quality_means.json").write_text(json.dumps({"0": {"m": 0.5}}))
    with pytest.raises(ValueError, match="quality"):
        Z.read_bundle(spark, str(tmp_path / "bundles"))


def test_archives_are_checked(tmp_path):
    import hashlib
    import io
    import tarfile

    from quaymark.sources import files as Z

    def pack(name, entry):
        with tarfile.open(tmp_path / name, "w") as tar:
            info = tarfile.TarInfo(entry)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"hi"))
        return str(tmp_path / name)

    good = pack("a.tar", "x/y.txt")
    assert Z.extract_archive(good, str(tmp_path / "out"), hashlib.sha256(open(good, "rb").read()).hexdigest()) == ["x/y.txt"]
    with pytest.raises(ValueError, match="hash"):
        Z.extract_archive(good, str(tmp_path / "out"), "00")
    with pytest.raises(ValueError, match="extracted"):
        Z.extract_archive(pack("b.tar", "../evil.txt"), str(tmp_path / "out2"))
    assert not (tmp_path / "evil.txt").exists()


def test_tables_of_other_programs(spark, tmp_path):
    from quaymark.sources import files as Z

    (tmp_path / "l.csv").write_text("prompt_id,model_id,label,extra\n1,0,1,x\n1,1,0,y\n2,1,1,z\n")
    labels = Z.read_labels(spark, str(tmp_path / "l.csv"))
    assert {tuple(r) for r in Z.label_rows(labels, [0, 1]).collect()} == {(1, 1, 0), (2, 0, 1)}
    (tmp_path / "p.jsonl").write_text('{"id": "a", "text": "t", "register": "low"}\n')
    assert Z.read_probes(spark, str(tmp_path / "p.jsonl")).first()["note"] is None
    df = spark.range(3).withColumn("a", F.array(F.col("id")))
    Z.write_version(df, str(tmp_path / "t"), "v1")
    Z.write_version(df.where("id > 0"), str(tmp_path / "t"), "v2")
    assert Z.read_latest(spark, str(tmp_path / "t")).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        Z.write_version(df, str(tmp_path / "t"), "v2")
    Z.save_matrix(df, str(tmp_path / "m"))
    assert Z.load_matrix(spark, str(tmp_path / "m")).count() == 3
    with pytest.raises(ValueError):
        Z.load_matrix(spark, str(tmp_path / "t" / "v1"))
    for form in ("json", "csv", "parquet"):
        Z.export(df, str(tmp_path / f"e-{form}"), form)
    assert spark.read.option("header", True).csv(str(tmp_path / "e-csv")).count() == 3
    Z.write_tables({"one": df.drop("a")}, str(tmp_path / "x"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x/one")).count() == 3
