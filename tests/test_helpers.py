import os
import tempfile

from pyspark.sql import functions as F

from corpuslab.functions import fmt
from corpuslab.operators import artifacts as AR
from corpuslab.operators import manifests as M
from corpuslab.operators import tokens as TK
from corpuslab.sources import files


def test_fmt_helpers(spark):
    df = spark.createDataFrame([("s3://bkt/a/b.json", "s3://root/", "/runs/", "1:1:4, 2:1:4", 2.675, None, 1234567)],
                               "uri string, root string, part string, cfg string, x double, y double, n long")
    r = df.select(
        fmt.s3_split(F.col("uri")).alias("s3"), fmt.path_join(F.col("root"), F.col("part"), F.lit("x.bin")).alias("p"),
        fmt.basename(F.col("uri")).alias("b"), fmt.relative_path(F.col("uri"), F.lit("s3://bkt")).alias("rel"),
        fmt.parse_configs(F.col("cfg")).alias("c"), fmt.fmt_num(F.col("x")).alias("fx"), fmt.fmt_num(F.col("y")).alias("fy"),
        fmt.fmt_int(F.col("n")).alias("fn"), fmt.round_half_up(F.col("x"), 2).alias("r"),
        fmt.pluck(F.lit('{"files": [{"raw_checksum_sha256": "abc"}]}'), "$.files[0].raw_checksum_sha256").alias("pk"),
        fmt.pluck(F.lit('{"files": []}'), "$.files[0].raw_checksum_sha256").alias("pk0"),
        fmt.device_readings_mean(F.lit("10\n20\n 30")).alias("m"), fmt.device_readings_mean(F.lit("")).alias("m0"),
    ).collect()[0]
    assert (r.s3.bucket, r.s3.key) == ("bkt", "a/b.json")
    assert r.p == "s3://root/runs/x.bin" and r.b == "b.json" and r.rel == "a/b.json"
    assert [(c.num_gpus, c.num_nodes, c.batch_size) for c in r.c] == [(1, 1, 4), (2, 1, 4)]
    assert (r.fx, r.fy, r.fn, r.r) == ("2.68", "n/a", "1,234,567", 2.68)
    assert (r.pk, r.pk0, r.m, r.m0) == ("abc", "", 20.0, None)


def test_dataset_digest_is_layout_independent(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    a = M.dataset_digest(df, ["doc_id", "text"]).collect()[0]
    b = M.dataset_digest(df.repartition(7).orderBy(F.rand(3)), ["doc_id", "text"]).collect()[0]
    c = M.dataset_digest(df.filter("doc_id <> 3"), ["doc_id", "text"]).collect()[0]
    assert a == b and a.digest != c.digest and a.n_rows == 500


def test_replay_lineage_timing_limits(spark):
    man = spark.createDataFrame([("r", [("a.gz", "h1"), ("gone.gz", "h2")])],
                                "run_name string, files array<struct<artifact_location:string, raw_checksum_sha256:string>>")
    inv = spark.createDataFrame([("a.gz", "h1", 10)], "path string, raw_checksum_sha256 string, size_bytes long")
    rows = sorted((r.path, r.size_bytes) for r in M.replay(man, inv).collect())
    assert rows == [("a.gz", 10), ("gone.gz", None)]
    ds = spark.createDataFrame([("v1",), ("v2",)], "dataset_version string")
    runs = spark.createDataFrame([("v1", "run1")], "dataset_version string, run_id string")
    ck = spark.createDataFrame([("run1", "c/1")], "run_id string, checkpoint_path string")
    ev = spark.createDataFrame([("c/1", True)], "checkpoint_path string, passed boolean")
    pub = spark.createDataFrame([("c/1", "s3://m/latest")], "checkpoint_path string, published string")
    lin = {r.dataset_version: r.published for r in M.lineage(ds, runs, ck, ev, pub).collect()}
    assert lin == {"v1": "s3://m/latest", "v2": None}
    st = spark.createDataFrame([("r", 1, 0.1, 0.2), ("r", 2, 0.3, 0.4)], "run_name string, step int, forward_sec double, backward_sec double")
    t = M.step_timing(st).collect()[0]
    assert t.steps == 2 and abs(t.avg_total_ms - 500.0) < 1e-9
    assert M.first_n(spark.range(10), ["id"], 3).count() == 3 and M.first_n(spark.range(10), ["id"], 0).count() == 10
    sp = spark.createDataFrame([("wikitext", "wikitext-2", "test"), ("wikitext", "wikitext-2", "train")], "dataset string, config string, split string")
    assert M.select_split(sp, "wikitext/wikitext-2", "test").count() == 1
    mb = M.map_batches(spark.range(5), lambda b: b.assign(sq=b.id * b.id)[["sq"]], "sq long")
    assert sorted(r.sq for r in mb.collect()) == [0, 1, 4, 9, 16]
    enc = TK.external_tokenizer(lambda: (lambda t: [ord(c) for c in t]))
    assert list(spark.createDataFrame([("ab",)], "t string").select(enc("t").alias("x")).collect()[0].x) == [97, 98]


def test_artifacts(spark):
    ck = spark.createDataFrame([("runs/r/checkpoint-9",), ("runs/r/checkpoint-10",), ("runs/r/checkpoint-x",)], "path string")
    assert [r.s for r in ck.select(AR.checkpoint_step().alias("s")).collect()] == [9, 10, None]
    listing = spark.createDataFrame([("a", "state.pt"), ("b", "config.json"), ("b", "model.safetensors"), ("c", "state.pt"),
                                     ("c", "sub/config.json")], "artifact string, rel_path string")
    kinds = {r.artifact: r.kind for r in AR.artifact_kind(listing).collect()}
    assert kinds == {"a": "raw_checkpoint", "b": "serveable", "c": "serveable"}
    idx = {r.artifact: list(r.files) for r in AR.artifact_index(listing).collect()}
    assert idx["b"] == ["config.json", "model.safetensors"]
    f = spark.createDataFrame([("m", "b.bin", bytearray(b"xy")), ("m", "a.txt", bytearray(b"z"))], "artifact string, rel_path string, content binary")
    d1 = AR.directory_digest(f).collect()[0]
    d2 = AR.directory_digest(f.repartition(3)).collect()[0]
    assert d1 == d2 and d1.artifact_file_count == 2 and d1.artifact_size_bytes == 3
    # integrity: ok / corrupt / missing / unlisted
    man = spark.createDataFrame([("p1", "h"), ("p2", "h"), ("p3", "h")], "path string, checksum string")
    obs = spark.createDataFrame([("p1", "h"), ("p2", "x"), ("p4", "h")], "path string, checksum string")
    st = {r.path: r.status for r in AR.integrity(man, obs).collect()}
    assert st == {"p1": "ok", "p2": "corrupt", "p3": "missing", "p4": "unlisted"}


def test_newest_artifact_publish_markdown(spark):
    d = tempfile.mkdtemp(prefix="art-")
    os.makedirs(os.path.join(d, "run1"))
    for i, name in enumerate(["eval_a.json", "eval_b.json"]):
        p = os.path.join(d, "run1", name)
        with open(p, "w") as fh:
            fh.write("{}")
        os.utime(p, (1000 + i, 1000 + i))
    got = files.newest_artifact(spark, d, "*.json").collect()
    assert len(got) == 1 and got[0].path.endswith("eval_b.json")
    target = files.publish_versioned(spark.range(3), d, "v1")
    assert spark.read.parquet(target).count() == 3
    assert spark.read.json(os.path.join(d, "latest")).collect()[0].version == "v1"
    try:
        files.publish_versioned(spark.range(3), d, "v1")
        raise AssertionError("a published version must be immutable")
    except Exception as e:  # noqa: BLE001
        assert "already exists" in str(e) or "PATH_ALREADY_EXISTS" in str(e)


def test_manifest_roundtrip_and_timestamp(spark):
    d = tempfile.mkdtemp(prefix="man-")
    m = spark.createDataFrame([("run-1", 5, ["min_content_bytes", "nfc_normalization"])],
                              "run_name string, file_count long, filters_applied array<string>")
    files.write_manifest(m, os.path.join(d, "m"))
    back = files.read_manifest(spark, os.path.join(d, "m"), "run_name string, file_count long, filters_applied array<string>")
    r = back.collect()[0]
    assert (r.run_name, r.file_count, list(r.filters_applied)) == ("run-1", 5, ["min_content_bytes", "nfc_normalization"])
    ts = spark.range(1).select(fmt.utc_now_iso().alias("t")).collect()[0].t
    assert len(ts) >= 27 and ts[4] == "-" and ts[10] == "T"
