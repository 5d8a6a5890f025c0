"""One query per operator over its whole table, the pipeline's query, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import (chosen_path, conversations, decontaminate, exact_dedup, langid, licenses, mixing, periodic, pii, quality, simhash,
                           token_files, url_filter)
from corpuslab.llm.common import LOWER, UPPER
from corpuslab.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _fold(n: int, rest: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == rest


# Sources are grouped into domains by their number; weights are whole numbers, 1 where none is given.
DOMAINS = ("web", "books", "news")
WEIGHTS = {
    "web": 5, "books": 3, "news": 2,
    "web/en": 4, "web/de": 2, "web/fr": 2, "books/en": 3,
    "web/en/src0": 3, "web/en/src3": 2, "books/en/src1": 2,
}


def domain() -> Column:
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    return F.element_at(F.array(*map(F.lit, DOMAINS)), F.pmod(number, F.lit(len(DOMAINS))) + 1)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mixture(read_table(spark, sf_dir, "documents"), domain(), WEIGHTS)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read_table(spark, sf_dir, "documents"))


def token_output(docs: DataFrame) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(docs, token_files.default_tokenizer()))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n_ columns count base spans; spans and n_spans have the method's too."""
    found, c = pii.find_pii(read_table(spark, sf_dir, "documents"), columns=["doc_id"])
    base = F.col(c)["base"]["kind"]
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    written = F.transform(F.col(c)["spans"], lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", *counts, F.col(c)["base_sha256"].alias("base_sha256"), F.array_join(written, ",").alias("spans"),
                        F.size(F.col(c)["spans"]).cast("long").alias("n_spans"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.score_quality(docs, labels, ~_fold(5, 0)).withColumn("held_out", F.coalesce(_fold(5, 0), F.lit(False)))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    marked, c = decontaminate.mark(docs, benchmark, columns=["doc_id"])
    return marked.select("doc_id", *(F.col(c)[n].alias(n) for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, c = licenses.scan_licences(read_table(spark, sf_dir, "documents"), columns=["doc_id"])
    return found.select("doc_id", *(F.col(c)[n].alias(n) for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    judged, c = langid.train_and_identify(docs, ~_fold(3, 1), langid.default_vocabulary(), columns=["doc_id"])
    return judged.select("doc_id", F.coalesce(_fold(3, 1), F.lit(False)).alias("held_out"), F.col(c)["lang_pred"].alias("lang_pred"), F.col(c)["score"].alias("score"))


def op11_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(read_table(spark, sf_dir, "documents"))


def turned(df: DataFrame) -> Column:
    """The text whose words from the a-th on repeat p of them, where crc32(doc_id) is divisible by 10; a null doc_id leaves it as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " ")
    return F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), made).otherwise(F.col("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found, c = periodic.periodic_runs(docs.select("doc_id", turned(docs).alias("text")), columns=["doc_id"])
    runs = F.col(c)["runs"]
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period"))), F.lit("\n")))
    keys = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("p")))
    best = F.array_max(keys)
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), (-best["before"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period"),
        F.floor(1000 * best["length"] / -best["p"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col(c)["collapsed"], 256).alias("collapsed_sha256"))


def damaged(df: DataFrame) -> DataFrame:
    """Conversation rows with faults put in, by crc32(conv_id:turn); nulls are one space."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    h = F.crc32(F.concat_ws(":", *told[:2])) % 20
    role = F.when(h == 4, "user").otherwise(told[2])
    text = F.when(h == 1, "").when(h == 2, F.translate(told[3], ".!?", "")).otherwise(told[3])
    copies = F.when(h == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return df.where(h != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations")
    return conversations.Repair(damaged(given)).report(given.select("conv_id"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    ops = (op1_exact_dedup, op2_simhash, op3_mixing, op4_token_files, op5_pii, op6_url_filter, op7_quality, op8_decontaminate,
           op9_licences, op10_language_id, op11_chosen_path, op12_periodic, op13_conversations, pipeline)
    return {f.__name__: f for f in ops}


_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

_OP1 = f"""
WITH d AS (SELECT doc_id, sha256({_LOW}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""


def _level_sql(i: int) -> str:
    """Budgets of the tree's level i: the even rate that fills each child up to its capacity."""
    here, parent = mixing.LEVELS[: i + 1], mixing.LEVELS[:i]
    path = " || '/' || ".join(here)
    weights = " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.items())
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    order = f"{by} ORDER BY capacity::DOUBLE / weight::DOUBLE, {here[-1]}"
    up = f"JOIN b{i - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN (SELECT least(sum(tokens), sum(tokens) * 4) AS given FROM leaf)"
    return f"""
n{i} AS (SELECT *, CASE {path} {weights} ELSE 1 END::HUGEINT AS weight FROM
  (SELECT {', '.join(here)}, sum(tokens)::HUGEINT AS tokens, (sum(tokens) * 4)::HUGEINT AS capacity FROM leaf GROUP BY ALL) {up}),
s{i} AS (SELECT *,
  given - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
  sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM n{i}),
r{i} AS (SELECT *, capacity * weights <= left_over * weight AS filled,
  first_value(CASE WHEN capacity * weights > left_over * weight THEN left_over END IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rate_left,
  first_value(CASE WHEN capacity * weights > left_over * weight THEN weights END IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rate_weights FROM s{i}),
b{i} AS (SELECT {', '.join(here)}, {'tokens, ' if i == 2 else ''}
  CASE WHEN filled THEN capacity ELSE least(capacity, (rate_left::HUGEINT * weight) // rate_weights::HUGEINT) END::HUGEINT AS given FROM r{i})"""


_OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(CASE try_cast(regexp_extract(source, '(\\d+)$', 1) AS INT) % 3
    {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(DOMAINS))} END, '{mixing.NONE}') AS domain,
  coalesce(lang, '{mixing.NONE}') AS lang, coalesce(source, '{mixing.NONE}') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM d GROUP BY ALL),
{','.join(_level_sql(i) for i in range(3))},
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 1 END AS f,
  CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS part FROM b2),
k AS (SELECT d.*, p.f, p.part, md5('{mixing.SEED}:' || f || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM d JOIN p USING (domain, lang, source)),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id NULLS FIRST, n_tokens
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k),
t AS (SELECT *, greatest(0, least(n_tokens, part - start)) AS taken FROM o)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, f::BIGINT AS full_epochs, taken::BIGINT AS part_tokens,
  (f * n_tokens + taken)::BIGINT AS taken_tokens FROM t
"""

_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP8 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, ws, least(len(ws), 13) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(ws[p : p + k - 1], ' ') AS g
  FROM i, unnest(range(1, len(ws) - k + 2)) AS t(p)),
lengths AS (SELECT DISTINCT k FROM windows),
runs AS (SELECT doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') AS g FROM w, lengths, unnest(range(1, len(ws) - k + 2)) AS t(p)),
met AS (SELECT doc_id, item_id, p, k FROM runs JOIN windows USING (k, g)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP11 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS t(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, low) AS (SELECT a, a FROM l UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node WHERE r.low < l.b),
k AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(low, doc_id) = doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k ON node = doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op3_mixing": _OP3, "op8_decontaminate": _OP8, "op11_chosen_path": _OP11}
