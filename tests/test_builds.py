"""Hash tree of builds, packed shards on disk, atomic publishing, and groups that are null."""

import glob
import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from corpuslab.operators.builds import LEAF, diff_builds, differing_ranges
from corpuslab.operators.dedup import verdict_counts
from corpuslab.plans.gates import manifest_of
from corpuslab.sources import files
from corpuslab.sources.packed import PackedWriter, read_packed, token_bytes, write_packed


def _build(spark, rows):
    return spark.createDataFrame(rows, "k long, text string, other int").repartition(3)


def _diff(left, right):
    by = {}
    for side, rows in enumerate((left, right)):
        for k, t, _ in rows:
            low = None if k is None else k // LEAF * LEAF
            by.setdefault(low, ({}, {}))[side].setdefault(k, []).append(t)
    out = []
    for low, (a, b) in by.items():
        same = lambda k, a=a, b=b: sorted(a[k], key=str) == sorted(b[k], key=str)
        missing, added = len(a.keys() - b.keys()), len(b.keys() - a.keys())
        changed = sum(not same(k) for k in a.keys() & b.keys())
        if missing or added or changed:
            out.append((low, None if low is None else low + LEAF - 1, sum(map(len, a.values())), sum(map(len, b.values())), missing, added, changed))
    return sorted(out, key=repr)


def test_builds_that_differ(spark):
    rnd = random.Random(1)
    left = [(k, f"t{k}", 1) for k in [*range(-300, 5000, 3), 10**12, 10**12 + 1]] + [(None, "x", 1), (None, None, 2), (9, "t9", 1), (12, None, 1)]
    right = [(k, t if rnd.random() < 0.99 else "new", 7) for k, t, _ in left if rnd.random() < 0.99] + [(4, "more", 1), (2 * 10**12, "far", 0)]
    right = [(k, None if k is None and t == "x" else t, o) for k, t, o in right]
    got = diff_builds(_build(spark, left), _build(spark, right), "k", ["text"]).collect()
    assert sorted(map(tuple, got), key=repr) == _diff(left, right) and len(got) > 3


def test_equal_builds_have_no_ranges(spark):
    rows = [(k, f"t{k}", k) for k in range(1000)] + [(None, "x", 1)]
    shuffled = random.Random(2).sample(rows, len(rows))
    assert diff_builds(_build(spark, rows), _build(spark, shuffled), "k", ["text"]).count() == 0
    none = _build(spark, [])
    assert diff_builds(none, none, "k", ["text"]).count() == 0
    assert diff_builds(_build(spark, rows[:5]), none, "k", ["text"]).collect()[0]["missing"] == 5


def test_only_odd_ranges_are_descended(spark):
    rows = [(k, "t", 1) for k in range(LEAF * 600)]
    odd = [(k, "u" if k == 12_345 else t, o) for k, t, o in rows]
    found = differing_ranges(_build(spark, rows), _build(spark, odd), "k", ["text"]).collect()
    assert [r["range"] for r in found] == [12_345 // LEAF]


def _sequences(spark, n, length=7):
    return spark.range(n).select(F.col("id").alias("seq_id"), F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: (F.col("id") * 31 - i * 1000).cast("int")).alias("tokens"))


@pytest.mark.parametrize("n,shards", [(0, 2), (1, 3), (10_000, 4)])
def test_packed_shards_round_trip(spark, tmp_path, n, shards):
    given = _sequences(spark, n)
    path = f"{tmp_path}/packed"
    write_packed(given.orderBy(F.rand(1)), path, shards)
    assert sorted(map(tuple, read_packed(spark, path).collect())) == sorted(map(tuple, given.collect()))
    index = json.load(open(f"{path}/index.json"))
    assert index["sequences"] == n and not os.path.exists(f"{path}/_writing")
    whole = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/*.bin")))
    assert whole == b"".join(t.to_bytes(4, "little", signed=True) for r in given.orderBy("seq_id").collect() for t in r["tokens"])
    with pytest.raises(Exception, match="already"):
        write_packed(given, path, shards)


def test_packed_bytes_round_trip(spark, tmp_path):
    """Binary tokens, a byte each, are written as the integers they stand for, and come back as the same bytes."""
    rows = [(i, bytes((i * 7 + j * 31) % 256 for j in range(64))) for i in range(300)]
    given = spark.createDataFrame(rows, "seq_id long, tokens binary").repartition(5)
    write_packed(given, f"{tmp_path}/packed", 3)
    back = read_packed(spark, f"{tmp_path}/packed")
    assert {r["seq_id"]: bytes(r["tokens"]) for r in back.collect()} == dict(rows)
    assert sorted((r["seq_id"], bytes(r["packed"])) for r in token_bytes(back.repartition(2)).collect()) == rows
    none = token_bytes(back.where("seq_id < 0"))
    assert none.columns == ["seq_id", "packed"] and none.count() == 0


def test_failed_write_leaves_no_shard(spark, tmp_path):
    path = f"{tmp_path}/packed"
    uneven = _sequences(spark, 500).withColumn("tokens", F.when(F.col("seq_id") == 444, F.array(F.lit(1))).otherwise(F.col("tokens")))
    with pytest.raises(Exception, match="one length"):
        write_packed(uneven, path, 3)
    assert not glob.glob(f"{path}/*.bin") and not os.path.exists(f"{path}/index.json")
    write_packed(_sequences(spark, 500), path, 3)
    assert read_packed(spark, path).count() == 500


def test_a_killed_task_leaves_nothing_a_reader_sees(spark, tmp_path):
    """What a lost attempt wrote is no part of the commit, and goes with it."""
    import pyarrow as pa

    path = f"{tmp_path}/packed"
    writer = PackedWriter(path)

    def batch(first, n):
        return pa.record_batch([pa.array(range(first, first + n), pa.int64()), pa.array([[1, 2]] * n, pa.list_(pa.int32()))], names=["seq_id", "tokens"])

    def killed():
        yield batch(0, 5)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(killed())
    first, second = writer.write(iter([batch(5, 3)])), writer.write(iter([batch(0, 5)]))
    assert not os.path.exists(f"{path}/index.json")
    writer.commit([first, None, second])
    assert sorted(os.listdir(path)) == ["index.json", "shard-00000.bin", "shard-00001.bin"]
    assert [r["seq_id"] for r in read_packed(spark, path).orderBy("seq_id").collect()] == list(range(8))


def test_readers_always_find_a_version(spark, tmp_path):
    root = str(tmp_path)
    for v in ("v1", "v2"):
        files.publish_versioned(spark.range(3 if v == "v1" else 5), root, v)
    pointer, seen, stop = f"{root}/latest", set(), threading.Event()

    def read():
        while not stop.is_set():
            seen.add(json.load(open(pointer))["version"])  # never missing, empty or half

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(60):
        files.point_latest(spark, root, "datasets", ("v1", "v2")[i % 2])
    stop.set()
    reader.join()
    assert seen == {"v1", "v2"}
    rows, version = files.read_latest(spark, root)
    assert (rows.count(), version) == (5, "v2")


def test_counts_add_up_where_groups_are_null(spark):
    rows = [(i, None if i % 2 else "en", None if i % 2 else "s", "passed", f"h{i % 3}" if i % 2 else f"g{i}", 10, 10) for i in range(12)]
    cls = spark.createDataFrame(rows, "doc_id long, lang string, source string, reason string, content_hash string, n_bytes long, norm_bytes long")
    got = {(r["lang"], r["verdict"]): r["n"] for r in verdict_counts(cls).collect()}
    assert got == {("en", "passed"): 6, (None, "passed"): 3, (None, "duplicate"): 3}
    run = {r["run_name"]: r for r in manifest_of(cls).collect()}[None]
    assert (run["output_record_count"], run["surviving"], run["dedup_total_input"], run["missing_phases"]) == (6, 3, 6, "")
