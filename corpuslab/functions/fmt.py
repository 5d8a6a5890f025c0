"""Formatting, path and small parsing helpers (C11-C16, C18, C20) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int) -> Column:
    """C11: Spark's ``round`` is half-up on the decimal value (DuckDB agrees; Python's ``round``
    is half-even on the binary value, e.g. 2.675 -> 2.67 there, 2.68 here)."""
    return F.round(c, digits)


def path_join(root: Column, *parts: Column) -> Column:
    """``root/part/...`` with single slashes, like the reference's ``s3_join``."""
    cleaned = [F.regexp_replace(root, "/+$", "")] + [F.regexp_replace(p, "^/+|/+$", "") for p in parts]
    return F.concat_ws("/", *cleaned)


def basename(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-1))


def relative_path(path: Column, root: Column) -> Column:
    """``path`` below ``root`` (null when it is not below it)."""
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, 1 << 30))


def s3_split(uri: Column) -> Column:
    """struct(bucket, key) of an ``s3://bucket/key`` URI; nulls for anything else."""
    pat = r"^s3://([^/]+)/(.*)$"
    ok = uri.rlike(pat)
    return F.struct(F.when(ok, F.regexp_extract(uri, pat, 1)).alias("bucket"),
                    F.when(ok, F.regexp_extract(uri, pat, 2)).alias("key"))


def pluck(json_col: Column, path: str, default: str = "") -> Column:
    """C14: nested lookup in a JSON document with a default, e.g. ``$.files[0].raw_checksum_sha256``."""
    return F.coalesce(F.get_json_object(json_col, path), F.lit(default))


def parse_configs(spec: Column) -> Column:
    """``"gpus:nodes:batch,..."`` -> array<struct<num_gpus, num_nodes, batch_size>>."""
    parts = F.transform(F.split(spec, ","), lambda x: F.split(F.trim(x), ":"))
    return F.transform(parts, lambda p: F.struct(
        p[0].cast("int").alias("num_gpus"), p[1].cast("int").alias("num_nodes"), p[2].cast("int").alias("batch_size")))


def fmt_num(c: Column, digits: int = 2) -> Column:
    """Fixed digits, null -> 'n/a'."""
    return F.when(c.isNull(), F.lit("n/a")).otherwise(F.format_string(f"%.{digits}f", c))


def fmt_int(c: Column) -> Column:
    """Thousands separators, null -> 'n/a'."""
    return F.coalesce(F.format_number(c.cast("long"), 0), F.lit("n/a"))


def utc_now_iso() -> Column:
    """Build timestamp (kept out of every checksum)."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def device_readings_mean(csv_line: Column) -> Column:
    """C20 + A16: mean of a ``nvidia-smi --format=csv,noheader,nounits`` reading list (one value
    per GPU, separated by newlines or commas); null instead of dividing by zero."""
    vals = F.filter(F.transform(F.split(F.trim(csv_line), r"[\n,]"), lambda x: F.trim(x).try_cast("double")),
                    lambda x: x.isNotNull())
    n = F.size(vals)
    return F.when(n > 0, F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / n)
