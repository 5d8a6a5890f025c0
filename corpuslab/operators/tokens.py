"""Tokenization and fixed-length packing.

Tokenizers (X1):
* ``byte``: UTF-8 byte = token id. Token arrays never need to exist: a packed sequence of bytes is
  a concatenation of binary slices, cut JVM-side with ``substring`` on ``encode(text)``.
* ``word``: ``[\\p{L}\\p{N}]+`` matches; ids from a vocabulary fitted on the corpus (frequency desc,
  word asc, ids from 1). The vocabulary grows with the corpus and is never broadcast whole: its
  ``FREQUENT`` first words, a bounded table, give nearly all tokens their ids where they are read;
  only the tokens of other words are shuffled to the rest of the vocabulary.

Packing (W3) follows the reference: documents in order, concatenated without separator, cut into
sequences of exactly ``L`` tokens, the last partial sequence dropped. With ``off`` = tokens before a
document (W2, ``running_offsets``), token ``i`` of the document lands in sequence
``(off + i) div L`` at slot ``(off + i) mod L``; every sequence group holds at most L tokens, so the
shuffle by sequence id has no skew whatever the document sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpuslab.operators.ordering import dense_positions, running_offsets
from corpuslab.session import stage

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def _words(docs: DataFrame, text_col: str) -> Column:
    """The words of a column of texts, or the column itself if its texts were cut into words before."""
    return F.col(text_col) if isinstance(docs.schema[text_col].dataType, ST.ArrayType) else words(F.col(text_col))


def n_tokens(text: Column, tokenizer: str) -> Column:
    if tokenizer == "byte":
        return F.octet_length(text).cast("long")
    if tokenizer == "word":
        return F.regexp_count(text, F.lit(WORD)).cast("long")
    raise ValueError(f"unknown tokenizer {tokenizer!r}")


def fit_vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n, id): ids by frequency desc then word asc, from 1. Shuffles: partial+final count
    by word, then the range exchange of ``dense_positions`` over the distinct words."""
    counts = docs.select(F.explode(_words(docs, text_col)).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = dense_positions(counts, [("n", True), "word"], "id", persist_input=True)
    # staged: read by the frequent-word broadcast and by the join of the rest
    return stage(ranked.withColumn("id", (F.col("id") + 1).cast("int")), "vocab")


def token_offsets(docs: DataFrame, tokenizer: str, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(order key, n_tokens, off) with ``off`` the exclusive running token count."""
    cut = tokenizer == "word" and isinstance(docs.schema[text_col].dataType, ST.ArrayType)
    n = F.array_size(text_col).cast("long") if cut else n_tokens(F.col(text_col), tokenizer)
    counted = docs.select(order_col, n.alias("n_tokens"))
    return running_offsets(counted, [order_col], "n_tokens", "off", persist_input=tokenizer != "byte")


def _idiv(c: Column, L: int) -> Column:
    """Exact integer division of a non-negative long by L."""
    return ((c - F.pmod(c, F.lit(L))) / L).cast("long")


def _pieces(docs_off: DataFrame, L: int, text_col: str) -> DataFrame:
    """(seq_id, start, piece binary) for the byte tokenizer: one row per document and sequence it
    touches. The slices are cut inside one ``transform`` over the sequence range, so each exploded
    row carries only its own slice, never a copy of the whole document."""
    off, n = F.col("off"), F.col("n_tokens")

    def cut(b, s):
        start = F.greatest(off, s * L)
        end = F.least(off + n, (s + 1) * L)
        return F.struct(s.alias("seq_id"), start.alias("start"),
                        F.substring(b, (start - off + 1).cast("int"), (end - start).cast("int")).alias("piece"))

    # a lambda's variable is computed once: inside ``cut`` the text would be encoded again for every slice
    b = F.encode(F.col(text_col), "UTF-8")
    pieces = F.transform(F.array(b), lambda x: F.transform(F.sequence(_idiv(off, L), _idiv(off + n - 1, L)), lambda s: cut(x, s)))[0]
    return docs_off.filter(n > 0).select(F.explode(pieces).alias("p")).select(
        F.col("p.seq_id").cast("long").alias("seq_id"), "p.start", "p.piece")


def pack_bytes(docs: DataFrame, L: int, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """W3 with byte tokens: (seq_id, packed binary of exactly L bytes)."""
    offs = token_offsets(docs, "byte", order_col, text_col)
    docs_off = docs.select(order_col, text_col).join(offs, on=order_col)
    grouped = _pieces(docs_off, L, text_col).groupBy("seq_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("_p")
    )
    packed = grouped.select(
        "seq_id",
        F.aggregate("_p", F.lit(bytearray()).cast("binary"), lambda acc, x: F.concat(acc, x["piece"])).alias("packed"),
    )
    return packed.filter(F.octet_length("packed") == L)


FREQUENT, FREQUENT_LENGTH = 1 << 16, 64  # words of the broadcast vocabulary and their code points: under 17 MB of text


def join_word_ids(tokens: DataFrame, vocab: DataFrame, salt_cols: list[str], n_hot: int | None = None,
                  salts: int | None = None) -> DataFrame:
    """Attach vocabulary ids to token rows (``word`` column), salting the hot words.

    Ids rank words by frequency, so any word holding more than 1/P of all tokens is among the top P
    ids: that set (at most P rows, a proven bound) is broadcast to tag the token side, whose hot
    tokens get a salt in [0, salts) from their own key; the hot vocabulary rows are replicated once
    per salt. The shuffle join on (word, salt) then spreads a word holding a third of all tokens
    over ``salts`` tasks instead of one. Both default to the number of shuffle partitions."""
    n_parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_hot, salts = n_hot or n_parts, salts or n_parts
    hot = F.broadcast(vocab.filter(F.col("id") <= n_hot).select("word", F.lit(True).alias("_hot")))
    tagged = tokens.join(hot, on="word", how="left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salts))).otherwise(F.lit(0))
    tagged = tagged.withColumn("_salt", salt.cast("int")).drop("_hot")
    replicas = F.when(F.col("id") <= n_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    v = vocab.select("word", "id", F.explode(replicas).alias("_salt"))
    return tagged.join(v, on=["word", "_salt"]).drop("_salt")


ROWS = 512  # documents looked up at a time


def _slots(batches: Iterator[pa.RecordBatch], near: pa.Table, L: int) -> Iterator[pa.RecordBatch]:
    """(key, at, words) to (key, slots, rest_k, rest): slots are longs of (k, id) of the words in ``near``, the others keep
    their k. k counts from ``at``; with ``L`` the count is cut into sequences, and key is the sequence."""
    known, ids = near.column("word").combine_chunks(), near.column("id").to_numpy().astype(np.int64)
    for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
        lists = b.column(2)
        n, flat = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), lists.flatten()
        if not len(flat):
            continue
        doc = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(flat)) - (np.cumsum(n) - n)[doc] + b.column(1).to_numpy()[doc]
        seq, k = (k // L, k % L) if L else (doc, k)
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1])]))
        found = pc.index_in(flat, value_set=known.cast(flat.type))
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        slots = k[hit] << 32 | ids[found.drop_null().to_numpy()]
        ends = np.append(first[1:], len(flat))
        hits = np.concatenate([[0], np.cumsum(hit)[ends - 1]]).astype(np.int32)
        rests = pa.array((np.concatenate([[0], ends]) - hits).astype(np.int32))
        yield pa.record_batch([
            pa.array(seq[first]) if L else b.column(0).take(pa.array(doc[first])),
            pa.ListArray.from_arrays(pa.array(hits), pa.array(slots)),
            pa.ListArray.from_arrays(rests, pa.array(k[~hit])),
            pa.ListArray.from_arrays(rests, flat.filter(pa.array(~hit))),
        ], names=["key", "slots", "rest_k", "rest"])


def collect_word_ids(docs: DataFrame, vocab: DataFrame, key: str, L: int = 0, n_frequent: int = FREQUENT) -> DataFrame:
    """(key, ids array<int> in the words' order) of documents (key, at, words), ``at`` the place of the first word. With
    ``L`` the words of all documents are one row, cut into sequences of ``L``, and key is the sequence.

    The ``n_frequent`` first words of at most ``FREQUENT_LENGTH`` code points are broadcast (a proven
    bound) and looked up a batch of documents at a time, so their tokens are never rows. Only the tokens of other
    words are shuffled as rows to the rest of the vocabulary, salted, since a word too long to be broadcast may
    still be hot."""
    frequent = (F.col("id") <= n_frequent) & (F.length("word") <= FREQUENT_LENGTH)
    near = docs.sparkSession.sparkContext.broadcast(vocab.filter(frequent).select("word", "id").toArrow())
    schema = ST.StructType([ST.StructField("_key", ST.LongType() if L else docs.schema[0].dataType)]).add(
        "slots", ST.ArrayType(ST.LongType())).add("rest_k", ST.ArrayType(ST.LongType())).add("rest", ST.ArrayType(ST.StringType()))
    cut = stage(docs.mapInArrow(lambda b: _slots(b, near.value, L), schema), "word-slots").withColumnRenamed("_key", key)
    rest = cut.select(key, F.explode(F.arrays_zip("rest_k", "rest")).alias("r")).select(key, F.col("r.rest_k").alias("k"), F.col("r.rest").alias("word"))
    rest = join_word_ids(rest, vocab.filter(~frequent), [key, "k"])
    slot = F.shiftleft("k", 32).bitwiseOR(F.col("id").cast("long"))
    slots = cut.select(key, "slots").unionByName(rest.select(key, F.array(slot).alias("slots")))
    gathered = slots.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("slots"))).alias("_slots"))
    ids = F.transform("_slots", lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    return gathered.select(key, ids.alias("ids"))


def pack_word_ids(docs: DataFrame, vocab: DataFrame, L: int, order_col: str = "doc_id",
                  text_col: str = "text", n_frequent: int = FREQUENT) -> DataFrame:
    """W3 with word tokens: (seq_id, tokens array<int> of exactly L ids).
    Shuffles: offsets (range), join offsets on the order key (one row per document), group by
    sequence id (a row per document and sequence, and at most L tokens per group), join of the rare words' tokens."""
    offs = token_offsets(docs, "word", order_col, text_col).filter(F.col("n_tokens") > 0)
    docs_off = docs.select(order_col, text_col).join(offs.select(order_col, "off"), on=order_col)
    ids = collect_word_ids(docs_off.select(order_col, "off", _words(docs, text_col).alias("words")), vocab, "seq_id", L, n_frequent)
    return ids.filter(F.size("ids") == L).select("seq_id", F.col("ids").alias("tokens"))


def doc_word_ids(docs: DataFrame, vocab: DataFrame, order_col: str = "doc_id", text_col: str = "text",
                 max_pos: int | None = None, n_frequent: int = FREQUENT) -> DataFrame:
    """(order key, ids array<int>) per document, in token order; documents without words get [].
    ``max_pos`` truncates: only the first so many tokens are generated."""
    ws = _words(docs, text_col)
    if max_pos is not None:
        ws = F.slice(ws, 1, max_pos)
    ids = collect_word_ids(docs.select(order_col, F.lit(0).cast("long").alias("at"), ws.alias("words")), vocab, order_col, n_frequent=n_frequent)
    return (
        docs.select(order_col)
        .join(ids, on=order_col, how="left")
        .select(order_col, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    )


def pack_stats(token_counts: DataFrame, L: int) -> DataFrame:
    """A5: input_records, total_tokens, sequence_count, tokens_packed, pack_efficiency (4 dp, 0.0
    when there are no tokens). Only one row per document is read."""
    t = token_counts.agg(F.count(F.lit(1)).alias("input_records"),
                         F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("total_tokens"))
    return t.select(
        "input_records",
        "total_tokens",
        F.floor(F.col("total_tokens") / L).cast("long").alias("sequence_count"),
        (F.floor(F.col("total_tokens") / L) * L).cast("long").alias("tokens_packed"),
        F.when(F.col("total_tokens") > 0, F.round(F.floor(F.col("total_tokens") / L) * L / F.col("total_tokens"), 4))
        .otherwise(F.lit(0.0)).alias("pack_efficiency"),
    )


def sequence_digest(tokens: Column) -> Column:
    """SHA-256 of the ids joined by single spaces."""
    return F.sha2(F.array_join(tokens.cast("array<string>"), " "), 256)


def external_tokenizer(loader):
    """X1 plug-in: ``loader()`` returns an ``encode(text) -> list[int]`` (e.g. a BPE tokenizer built
    from a local vocabulary file). It runs once per task; the iterator UDF then encodes Arrow batches."""
    @F.pandas_udf(ST.ArrayType(ST.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = loader()
        for s in batches:
            yield s.map(lambda t: None if t is None else [int(i) for i in enc(t)])

    return encode


def pad_truncate(ids: Column, L: int, pad_id: int = 0) -> tuple[Column, Column]:
    """Ids truncated or right-padded to L, and the attention mask (1 real, 0 pad)."""
    n = F.least(F.size(ids), F.lit(L))
    padded = F.concat(F.slice(ids, 1, L), F.array_repeat(F.lit(pad_id), F.lit(L) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(L) - n))
    return padded, mask


def synthetic_tokens(idx: Column, L: int = 32, V: int = 128) -> Column:
    """``(j % V + idx) % V`` for j in 0..L-1."""
    return F.transform(F.sequence(F.lit(0), F.lit(L - 1)), lambda j: ((j % V + idx) % V).cast("int"))


def epoch_shards(docs: DataFrame, epoch: int, world_size: int, batch_size: int, order_col: str = "doc_id") -> DataFrame:
    """A seeded permutation of the rows per epoch (order by SHA-256 of ``id:epoch``, then id),
    then the position is dealt round-robin to ``world_size`` ranks and cut into batches per rank."""
    seed = F.concat_ws(":", F.col(order_col).cast("string"), F.lit(str(epoch)))
    keyed = docs.select(order_col, F.sha2(seed, 256).alias("_h"))
    pos = dense_positions(keyed, ["_h", order_col], "pos")
    return pos.select(
        order_col,
        F.lit(epoch).alias("epoch"),
        (F.col("pos") % world_size).cast("int").alias("shard"),
        F.floor(F.floor(F.col("pos") / world_size) / batch_size).cast("long").alias("batch"),
    )
