"""Helpers the operators share: ASCII lower-casing, word splitting, and a join that splits hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: UTF-8 bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased; every other byte becomes a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only. ASCII texts take the fast built-in, which does the same to them."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[0-9a-z]`` and every code point from U+0080 on, as UTF-8."""
    return text.translate(WORD_BYTES).split() if text else []


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices (no copy), so that only some hundred texts exist as Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, salt: str) -> DataFrame:
    """Inner join on ``key``, unique in ``right``, whose column ``n`` says how many rows of ``left`` have it.

    A key with more than its share (rows / partitions) of ``left`` is split into as many salts as it
    has shares, by the hash of column ``salt``. There are fewer such keys than shuffle partitions, so
    the broadcast that marks them is bounded, and the copies of ``right``'s rows are at most two for
    each partition. Null keys do not join.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    share = max(1, total // partitions(left))
    salts = F.ceil(F.col(n) / F.lit(share)).cast("int")
    hot = right.where(F.col(n) > share).select(F.col(key).alias("_hot"), salts.alias("_salts"))
    tagged = (
        left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(salt), F.col("_salts")), F.lit(0)).cast("int"))
        .drop("_hot", "_salts")
    )
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return tagged.join(copies, [key, "_salt"]).drop("_salt")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_judgement(df: DataFrame, text_col: str, kind: str, judge: Callable[[list[str | bytes | None]], list],
                   columns: list[str] | None = None, name: str = "judged", as_bytes: bool = False) -> tuple[DataFrame, str]:
    """``columns`` of ``df`` (default: all) and a column of type ``kind`` that ``judge`` makes of some hundred texts.

    The column's name is the second result; it differs from every name in ``df``. A map over Arrow
    batches: no shuffle, and a lost task is simply run again.
    """
    name = free_name(df, name)
    keep = df.columns if columns is None else columns
    text = free_name(df, "_text")
    schema = StructType([*(df.schema[c] for c in keep), StructField(name, _parse(kind))])
    arrow = to_arrow_type(_parse(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = b.column(len(keep))
            texts = texts.cast(pa.large_binary()).to_pylist() if as_bytes else texts.to_pylist()
            made = pa.array(judge(texts), type=arrow)
            yield pa.record_batch([*b.columns[: len(keep)], made], names=[*keep, name])

    given = df.select(*keep, F.col(text_col).cast("string").alias(text))
    return given.mapInArrow(run, schema), name


def _parse(kind: str) -> DataType:
    return DataType.fromDDL(kind)
