import gzip
import os
import tempfile

from pyspark.sql import functions as F

from corpuslab.sources import archives, files

LONG = "Plain words make a long enough body for the filters to pass. " * 6

ARCH_CRLF = (
    "WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 10\r\n\r\nsoftware: x\r\n\r\n"
    "WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: http://a.example/1\r\nwarc-target-uri: http://a.example/LAST\r\n\r\n"
    + LONG + "\r\nsecond line\r\n\r\n"
    "WARC/1.0\r\nWARC-Type: conversion\r\n\r\n" + LONG + "\r\n\r\n"
    "WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: http://a.example/empty\r\n\r\n   \r\n\r\n"
)
ARCH_LF = (
    "WARC/1.0\nWARC-Type: conversion\nWARC-Target-URI: http://b.example/x\n\n" + "Ünïcödé text here. " * 15 + "\n\n"
    "WARC/1.0\nWARC-Type: conversion\nWARC-Target-URI: no blank line so all is body\n" + "x y z " * 3 + "\n"
)


def _write(d, name, data: bytes, compress=True):
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(gzip.compress(data) if compress else data)
    return p


def test_wet_reader(spark):
    d = tempfile.mkdtemp(prefix="wet-")
    raw1 = ARCH_CRLF.encode()
    raw2 = ARCH_LF.encode() + b"WARC/1.0\nWARC-Type: conversion\nWARC-Target-URI: u\n\nbad \xff\xfe bytes " + b"q" * 30 + b"\n"
    _write(d, "a.warc.wet.gz", raw1)
    _write(d, "b.warc.wet.gz", raw2)
    trunc = gzip.compress(ARCH_LF.encode() * 20)
    _write(d, "c.warc.wet.gz", trunc[: len(trunc) // 2], compress=False)
    _write(d, "d.warc.wet.gz", b"")
    probe = archives.probe_archives(spark, os.path.join(d, "*.gz"))
    ok = {os.path.basename(r.path): r.readable for r in probe.collect()}
    assert ok == {"a.warc.wet.gz": True, "b.warc.wet.gz": True, "c.warc.wet.gz": False, "d.warc.wet.gz": True}
    filesdf = probe.withColumn("file_index", F.dense_rank().over(__import__("pyspark.sql").sql.Window.orderBy("path")))
    recs = archives.read_wet(spark, filesdf).orderBy("file_index", "record_no").collect()
    got = [(r.uri, r.content) for r in recs]
    assert got == [
        ("http://a.example/LAST", LONG + "\r\nsecond line"),  # the last of two headers wins
        ("", LONG.strip()),  # no URI
        ("http://b.example/x", ("Ünïcödé text here. " * 15).strip()),
        ("u", "bad \ufffd\ufffd bytes " + "q" * 30),
    ]


def test_separator_ends_its_line(spark):
    """``WARC/1.0`` inside a line is text, whatever the archive's line ends."""
    d = tempfile.mkdtemp(prefix="wet-mid-")
    body = "As the header WARC/1.0 says, WARC/1.0; " + "more text " * 20 + "WARC/1.0"
    mixed = ("WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: a\r\n\r\n" + body + " end\r\n\r\n"
             "WARC/1.0\nWARC-Type: conversion\nWARC-Target-URI: b\n\n" + body + "!\n")
    _write(d, "a.gz", mixed.encode())
    two = gzip.compress(mixed[: len(mixed) // 2].encode()) + gzip.compress(mixed[len(mixed) // 2 :].encode())
    _write(d, "b.gz", two, compress=False)
    _write(d, "c.gz", two + b"\0" * 512, compress=False)  # padding
    probe = archives.probe_archives(spark, os.path.join(d, "*.gz"))
    assert [r.readable for r in probe.orderBy("path").collect()] == [True, True, False]
    from pyspark.sql import Window

    recs = archives.read_wet(spark, probe.withColumn("file_index", F.dense_rank().over(Window.orderBy("path")))).collect()
    assert sorted((r.file_index, r.uri, r.content) for r in recs) == [(i, u, body + e) for i in (1, 2) for u, e in (("a", " end"), ("b", "!"))]


def test_streams_equal_whole_reads(monkeypatch):
    """Pieces of any size give what decompressing and splitting whole contents gives."""
    import random
    import re
    import zlib

    rng = random.Random(5)
    words = [b"WARC/1.0\r\n", b"WARC/1.0\n", b"WARC/1.0", b"\r\n", b"\n", b"text ", b"\xff", "\u00e9".encode(), b"WARC/1", b"\xe2\x82"]
    for size in (1, 2, 3, 7, 50, 1 << 18):
        monkeypatch.setattr(archives, "CHUNK", size)
        for _ in range(60):
            members = [b"".join(rng.choices(words, k=rng.randrange(30))) for _ in range(rng.randrange(4))]
            data = b"".join(map(gzip.compress, members))
            pieces = [data[i : i + size] for i in range(0, len(data), size)]
            assert all(len(x) <= size for x in archives.decoded(pieces))
            want = [x for x in re.split(r"WARC/1\.0\r?\n", b"".join(members).decode("utf-8", "replace"))]
            assert list(archives.blocks(archives.decoded(pieces))) == want
            if members:
                for bad in (data[:-1], data + b"\0", data + b"x", b"x" + data, data[:5]):
                    try:
                        list(archives.decoded(bad[i : i + size] for i in range(0, len(bad), size)))
                        raise AssertionError(bad)
                    except zlib.error:
                        pass


def test_inventory(spark):
    import hashlib

    d = tempfile.mkdtemp(prefix="inv-")
    bomb = gzip.compress(b"\0" * 50_000_000)  # far more content than bytes
    cut = gzip.compress(ARCH_LF.encode())[:-3] + b"?" * 1_000_000
    sums = {"a.gz": bomb, "b c.gz": cut}
    for name, data in sums.items():
        _write(d, name, data, compress=False)
    probe = archives.probe_archives(spark, os.path.join(d, "*.gz")).withColumn("rel_path", F.element_at(F.split("path", "/"), -1))
    rows = archives.raw_inventory(probe, "CRAWL-1", "https://host.example/").collect()
    got = {r.source_url: (r.source_name, r.crawl_id, r.license, r.raw_checksum_sha256, r.size_bytes) for r in rows}
    assert got == {f"https://host.example/{n}": ("common_crawl", "CRAWL-1", archives.LICENSE, hashlib.sha256(x).hexdigest(), len(x))
                   for n, x in sums.items()}
    assert {r.readable for r in probe.where(F.col("path").endswith("b c.gz")).collect()} == {False}
    assert archives.raw_inventory(probe.drop("rel_path"), "c", "u").where("source_url is null").count() == 2
    empty = archives.read_wet(spark, probe.where("false").withColumn("file_index", F.lit(1)))
    assert empty.columns == ["file_index", "record_no", "uri", "content"] and empty.count() == 0


def test_json_keeps_nulls(spark):
    d = tempfile.mkdtemp(prefix="json-")
    df = spark.createDataFrame([("a", None)], "x string, y string")
    files.write_jsonl(df, os.path.join(d, "l"))
    files.write_manifest(df, os.path.join(d, "m"))
    for name in ("l", "m"):
        assert [r.value for r in spark.read.text(os.path.join(d, name)).collect()] == ['{"x":"a","y":null}']


def test_digest_separates_fields(spark):
    from corpuslab.operators.manifests import dataset_digest

    rows = [("a\tb", "c"), ("a", "b\tc"), ("a", None), ("a", "\\N"), ("a", "-"), ("a", "")]
    found = [dataset_digest(spark.createDataFrame([r], "x string, y string"), ["x", "y"]).first().digest for r in rows]
    assert len(set(found)) == len(rows)
    both = spark.createDataFrame(rows, "x string, y string")
    assert dataset_digest(both, ["x", "y"]).first() == dataset_digest(both.orderBy("y"), ["x", "y"]).first()


def test_normalize_archives_counts_malformed(spark):
    d = tempfile.mkdtemp(prefix="wet2-")
    _write(d, "a.gz", ARCH_CRLF.encode())
    _write(d, "b.gz", gzip.compress(b"WARC/1.0\r\n")[:5], compress=False)
    passed, stats = archives.normalize_archives(spark, os.path.join(d, "*.gz"))
    s = {(os.path.basename(r.path), r.reason): r.n for r in stats.collect()}
    assert s[("b.gz", "rejected_malformed")] == 1
    assert s[("a.gz", "total")] == 2  # the empty-body record is dropped before counting
    assert passed.count() == 2


def test_paths_jsonl_manifest_log(spark):
    d = tempfile.mkdtemp(prefix="files-")
    _write(d, "paths.gz", b"  a/1.gz\n\n b/2.gz \n")
    ps = archives.archive_paths(spark, os.path.join(d, "paths.gz")).collect()
    assert [(r.path_index, r.path) for r in ps] == [(1, "a/1.gz"), (2, "b/2.gz")]
    with open(os.path.join(d, "n.jsonl"), "w") as f:
        f.write('{"uri": "u", "text": "héllo", "content_hash": "h"}\n\n{"uri": "v", "text": "x"}\n')
    rows = files.read_jsonl(spark, os.path.join(d, "n.jsonl")).collect()
    assert [(r.uri, r.text, r.content_hash) for r in rows] == [("u", "héllo", "h"), ("v", "x", None)]
    missing = files.read_manifest(spark, os.path.join(d, "nope.json"), "run_name string, file_count long")
    assert missing.count() == 0
    with open(os.path.join(d, "train.log"), "w") as f:
        f.write("Resumed from step 4\nStep 10/20 | Loss: 7.2500 | LR: 1.00e-04 | Tokens/sec: 2132 | GPU Mem: 900MB\n"
                "noise\nStep 20/20 | Loss: 7.0000 | LR: 5.00e-05 | Tokens/sec: 2200 | GPU Mem: 901MB\n")
    lp = files.training_log_progress(spark, os.path.join(d, "train.log")).collect()[0]
    assert (lp.last_step, lp.last_loss, lp.last_tokens_per_sec, lp.resumed_from_step) == (20, 7.0, 2200.0, 4)
    packed = spark.createDataFrame([(0, [1, 2, 258])], "seq_id long, tokens array<int>")
    rec = files.packed_records(packed).collect()[0].record
    assert bytes(rec) == (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + (258).to_bytes(4, "little")


def test_archive_counts_read_records_once(spark):
    d = tempfile.mkdtemp(prefix="wet-once-")
    _write(d, "a.gz", ARCH_CRLF.encode())
    _, stats = archives.normalize_archives(spark, os.path.join(d, "*.gz"))
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow _records") == 1


def test_records_cut_at_the_first_blank_line(spark):
    """Only headers are taken apart; a record's body is what follows the first line of nothing but carriage returns."""
    head = "WARC-Type: conversion\nWARC-Target-URI: u"
    blocks = [head + "\n\nx\r\n\ny\n", head + "\r\r\n\r\r\n x ", "\n" + head, head + "\n\n", head + "\n", head + "\n \nWARC-Type: request\n\nb", head]
    raw = spark.createDataFrame([(1, i, b) for i, b in enumerate(blocks)], "file_index long, record_no long, block string")
    out = archives.parse_records(raw)
    assert sorted((r.record_no, r.uri, r.content) for r in out.collect()) == [(0, "u", "x\r\n\ny"), (1, "u", "x"), (6, "u", head)]
    assert "array_join" not in out._jdf.queryExecution().toString()
