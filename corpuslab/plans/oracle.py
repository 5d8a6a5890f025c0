"""DuckDB twins of the registered queries (the correctness oracle).

Written independently of the Spark code paths: plain SQL over the driver's views. Only the fixed values of
``functions/constants.py`` are shared.
"""

from __future__ import annotations

from corpuslab.functions import constants as K

# Written out here again, so that a wrong class on the Spark side shows.
PY_SPACE_CLASS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"\x{d}\x{a}|[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
NON_LETTER = r"\P{L}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+$', '', 'g')"


def sql_lines(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({x}, '{LINE_BREAK}'), "
            f"lambda y: lower({sql_strip('y')})), lambda y: y <> '')")


def sql_reason(x: str) -> str:
    bp = ", ".join(_q(s) for s in K.BOILERPLATE_LINES)
    lines = sql_lines(x)
    return (
        f"CASE WHEN strlen({x}) < {K.MIN_CONTENT_BYTES} THEN 'too_short' "
        f"WHEN length({x}) > 0 AND 1 - length(regexp_replace({x}, '{NON_LETTER}', '', 'g'))::DOUBLE / length({x}) "
        f"> {K.MAX_NON_ALPHA_RATIO}::DOUBLE THEN 'non_alpha_ratio' "
        f"WHEN len({lines}) = 0 THEN 'empty_after_strip' "
        f"WHEN len(list_filter({lines}, lambda z: z IN ({bp})))::DOUBLE / len({lines}) > {K.MAX_BOILERPLATE_RATIO}::DOUBLE "
        f"THEN 'boilerplate' END"
    )


def sql_normalize(x: str) -> str:
    collapsed = (f"regexp_replace(regexp_replace(nfc_normalize({x}), '[ \\t]+', ' ', 'g'), "
                 f"'\\n{{3,}}', chr(10) || chr(10), 'g')")
    return sql_strip(collapsed)


CLASSIFIED_CTE = f"""
cls_b AS (SELECT doc_id, lang, source, text, {sql_strip('text')} AS t FROM documents),
cls_1 AS (SELECT *, {sql_reason('t')} AS r1 FROM cls_b),
cls_2 AS (SELECT *, CASE WHEN r1 IS NULL THEN {sql_normalize('text')} END AS nt FROM cls_1),
cls_3 AS (SELECT *, CASE WHEN r1 IS NULL THEN {sql_reason('nt')} END AS r2 FROM cls_2),
cls AS (SELECT doc_id, lang, source, coalesce(r1, r2, 'passed') AS reason,
               CASE WHEN r1 IS NULL AND r2 IS NULL THEN nt END AS norm_text,
               CASE WHEN r1 IS NULL AND r2 IS NULL THEN sha256(nt) END AS content_hash,
               strlen(t)::BIGINT AS n_bytes
        FROM cls_3)"""

CORPUS_SQL: dict[str, str] = {
    "corpus_verdicts": f"""
WITH {CLASSIFIED_CTE},
firsts AS (SELECT min(doc_id) AS first_id FROM cls WHERE reason = 'passed' GROUP BY content_hash)
SELECT lang,
       CASE WHEN reason = 'passed' AND f.first_id IS NULL THEN 'duplicate' ELSE reason END AS verdict,
       count(*)::BIGINT AS n, sum(n_bytes)::BIGINT AS n_bytes
FROM cls LEFT JOIN firsts f ON cls.doc_id = f.first_id
GROUP BY ALL""",
    "filter_stats_rollup": f"""
WITH {CLASSIFIED_CTE},
k AS (SELECT source, CASE WHEN reason = 'passed' THEN 'passed' ELSE 'rejected_' || reason END AS key FROM cls)
SELECT CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, CASE WHEN grouping(key) = 1 THEN 'total' ELSE key END AS reason,
       count(*)::BIGINT AS n
FROM k GROUP BY ROLLUP (source, key)""",
    "normalize_text": f"""
WITH {CLASSIFIED_CTE}
SELECT doc_id, content_hash, strlen(norm_text)::BIGINT AS n_bytes FROM cls WHERE reason = 'passed'""",
    "dedup_exact": f"""
WITH {CLASSIFIED_CTE}
SELECT min(doc_id) AS doc_id, content_hash FROM cls WHERE reason = 'passed' GROUP BY content_hash""",
    "dedup_stats": f"""
WITH {CLASSIFIED_CTE},
t AS (SELECT count(*) AS total, count(DISTINCT content_hash) AS surv FROM cls WHERE reason = 'passed')
SELECT total::BIGINT AS total_input, (total - surv)::BIGINT AS duplicates_removed, surv::BIGINT AS surviving,
       CASE WHEN total > 0 THEN round((total - surv)::DOUBLE / total, 4) ELSE 0.0 END AS dedup_ratio
FROM t""",
}


DEDUPED_CTE = f"""{CLASSIFIED_CTE},
dd AS (SELECT doc_id, norm_text AS text FROM cls
       WHERE reason = 'passed' AND doc_id IN (SELECT min(doc_id) FROM cls WHERE reason = 'passed' GROUP BY content_hash))"""

_WORD = r"[\p{L}\p{N}]+"
_L = 1024

VOCAB_CTE = f"""
vocab_c AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM dd) GROUP BY w),
vocab AS (SELECT word, n, (row_number() OVER (ORDER BY n DESC, word))::INTEGER AS id FROM vocab_c),
toks AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos
         FROM (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS ws FROM dd))"""

TOKEN_SQL: dict[str, str] = {
    "token_counts": f"""
WITH {DEDUPED_CTE}
SELECT doc_id, strlen(text)::BIGINT AS n_bytes, len(regexp_extract_all(text, '{_WORD}'))::BIGINT AS n_words FROM dd""",
    "token_offsets": f"""
WITH {DEDUPED_CTE}
SELECT doc_id, strlen(text)::BIGINT AS n_tokens,
       coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
FROM dd""",
    "pack_bytes": f"""
WITH {DEDUPED_CTE},
o AS (SELECT doc_id, text, strlen(text) AS n,
             coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
      FROM dd WHERE strlen(text) > 0),
s AS (SELECT doc_id, text, n, off, unnest(range(off // {_L}, (off + n - 1) // {_L} + 1)) AS seq_id FROM o),
p AS (SELECT seq_id, greatest(off, seq_id * {_L}) AS st, least(off + n, (seq_id + 1) * {_L}) AS en, off, text FROM s),
h AS (SELECT seq_id, st, en - st AS len, substring(hex(encode(text)), 2 * (st - off) + 1, 2 * (en - st)) AS hx FROM p)
SELECT seq_id::BIGINT AS seq_id, sha256(unhex(string_agg(hx, '' ORDER BY st))) AS seq_digest
FROM h GROUP BY seq_id HAVING sum(len) = {_L}""",
    "word_vocabulary": f"""
WITH {DEDUPED_CTE}, {VOCAB_CTE}
SELECT word, n::BIGINT AS n, id FROM vocab""",
    "pack_words": f"""
WITH {DEDUPED_CTE}, {VOCAB_CTE},
o AS (SELECT doc_id, coalesce(sum(len(regexp_extract_all(text, '{_WORD}'))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM dd),
g AS (SELECT (o.off + toks.pos) // {_L} AS seq_id, (o.off + toks.pos) % {_L} AS k, vocab.id
      FROM toks JOIN o USING (doc_id) JOIN vocab USING (word))
SELECT seq_id::BIGINT AS seq_id, sha256(array_to_string(list(id ORDER BY k), ' ')) AS seq_digest
FROM g GROUP BY seq_id HAVING count(*) = {_L}""",
    "pack_stats": f"""
WITH {DEDUPED_CTE},
c AS (SELECT 'byte' AS tokenizer, strlen(text) AS n FROM dd WHERE strlen(text) > 0
      UNION ALL SELECT 'word', len(regexp_extract_all(text, '{_WORD}')) FROM dd WHERE strlen(text) > 0),
t AS (SELECT tokenizer, count(*) AS input_records, coalesce(sum(n), 0) AS total_tokens FROM c GROUP BY tokenizer)
SELECT tokenizer, input_records::BIGINT AS input_records, total_tokens::BIGINT AS total_tokens,
       (total_tokens // {_L})::BIGINT AS sequence_count, (total_tokens // {_L} * {_L})::BIGINT AS tokens_packed,
       CASE WHEN total_tokens > 0 THEN round((total_tokens // {_L} * {_L})::DOUBLE / total_tokens, 4) ELSE 0.0 END AS pack_efficiency
FROM t""",
    "pad_truncate": f"""
WITH {DEDUPED_CTE}, {VOCAB_CTE},
d AS (SELECT dd.doc_id, coalesce(list(vocab.id ORDER BY toks.pos) FILTER (WHERE vocab.id IS NOT NULL), []) AS ids
      FROM dd LEFT JOIN toks ON dd.doc_id = toks.doc_id AND toks.pos < 128 LEFT JOIN vocab ON toks.word = vocab.word
      GROUP BY dd.doc_id)
SELECT doc_id, len(ids)::BIGINT AS n_ids, len(ids)::BIGINT AS mask_sum,
       sha256(array_to_string(list_concat(ids, list_transform(range(128 - len(ids)), lambda x: 0)), ' ')) AS ids_digest
FROM d""",
    "synthetic_sequences": """
SELECT doc_id AS id, sha256(array_to_string(list_transform(range(0, 32), lambda j: (j % 128 + doc_id) % 128), ' ')) AS tokens_digest
FROM documents""",
}


GATE_SQL: dict[str, str] = {
    "perplexity_gate": f"""
WITH {DEDUPED_CTE},
vc AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM dd) GROUP BY w),
tot AS (SELECT ln(sum(n) + count(*)) AS lz FROM vc),
smp AS (SELECT source, doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
smp2 AS (SELECT source, doc_id, text FROM smp UNION ALL SELECT '*', doc_id, text FROM smp),
t2 AS (SELECT source, doc_id, unnest(regexp_extract_all(text, '{_WORD}')) AS word FROM smp2),
keep AS (SELECT source, doc_id FROM t2 GROUP BY source, doc_id HAVING count(*) >= 2),
sc AS (SELECT t2.source, sum((SELECT lz FROM tot) - ln(coalesce(vc.n, 0) + 1)) AS loss, count(*) AS ntok
       FROM t2 JOIN keep USING (source, doc_id) LEFT JOIN vc USING (word) GROUP BY t2.source),
g AS (SELECT DISTINCT source FROM smp2),
r AS (SELECT g.source, coalesce(ntok, 0) AS tokens_evaluated,
             CASE WHEN ntok > 0 THEN loss / ntok ELSE 'inf'::DOUBLE END AS avg_loss FROM g LEFT JOIN sc USING (source)),
r2 AS (SELECT *, exp(avg_loss) AS ppl FROM r),
b AS (SELECT ppl AS base FROM r2 WHERE source = '*')
SELECT source, tokens_evaluated, round(ppl, 4) AS perplexity,
       (ppl > 2000.0)::INTEGER + (ppl > base * 1.05)::INTEGER = 0 AS passed,
       (ppl > 2000.0)::INTEGER + (ppl > base * 1.05)::INTEGER AS n_reasons
FROM r2, b""",
    "perplexity_gate_first500": f"""
WITH {DEDUPED_CTE},
vc AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM dd) GROUP BY w),
tot AS (SELECT ln(sum(n) + count(*)) AS lz FROM vc),
capped AS (SELECT * FROM (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents) WHERE i <= 500),
ws AS (SELECT lang, regexp_extract_all(text, '{_WORD}')[1:512] AS w FROM capped),
t AS (SELECT lang, unnest(w) AS word FROM ws WHERE len(w) >= 2),
sc AS (SELECT lang, sum((SELECT lz FROM tot) - ln(coalesce(vc.n, 0) + 1)) AS loss, count(*) AS ntok FROM t LEFT JOIN vc USING (word) GROUP BY lang),
r AS (SELECT lang, coalesce(ntok, 0) AS tokens_evaluated, exp(CASE WHEN ntok > 0 THEN loss / ntok ELSE 'inf'::DOUBLE END) AS ppl
      FROM (SELECT DISTINCT lang FROM documents) LEFT JOIN sc USING (lang))
SELECT lang, tokens_evaluated, round(ppl, 4) AS perplexity, NOT ppl > 2000.0 AS passed FROM r""",
    "dataset_manifest": f"""
WITH {CLASSIFIED_CTE},
raw AS (SELECT source, count(*) AS source_file_count, sum(n_bytes)::BIGINT AS source_total_bytes FROM cls GROUP BY source),
norm AS (SELECT source, count(*) FILTER (WHERE reason = 'passed') AS output_record_count,
                count(*) FILTER (WHERE reason <> 'passed') AS rejected_count FROM cls GROUP BY source),
h AS (SELECT source, content_hash, count(*) AS c, max(strlen(norm_text)) AS b FROM cls WHERE reason = 'passed' GROUP BY source, content_hash),
d AS (SELECT source, sum(c)::BIGINT AS total_input, count(*) AS surviving, sum(b)::BIGINT AS token_count FROM h GROUP BY source)
SELECT raw.source AS run_name, source_file_count, source_total_bytes,
       coalesce(output_record_count, 0) AS output_record_count, coalesce(rejected_count, 0) AS rejected_count,
       coalesce(total_input, 0) AS dedup_total_input, coalesce(total_input - surviving, 0) AS duplicates_removed,
       coalesce(surviving, 0) AS surviving,
       coalesce(CASE WHEN total_input > 0 THEN round((total_input - surviving)::DOUBLE / total_input, 4) ELSE 0.0 END, 0.0) AS dedup_ratio,
       coalesce(token_count, 0) AS token_count, coalesce(token_count // 1024, 0) AS sequence_count,
       coalesce(CASE WHEN token_count > 0 THEN round((token_count // 1024 * 1024)::DOUBLE / token_count, 4) END, 0.0) AS pack_efficiency,
       concat_ws(',', CASE WHEN surviving IS NULL THEN 'dedup' END,
                      CASE WHEN coalesce(token_count, 0) = 0 THEN 'tokenize' END) AS missing_phases
FROM raw LEFT JOIN norm ON raw.source IS NOT DISTINCT FROM norm.source LEFT JOIN d ON raw.source IS NOT DISTINCT FROM d.source""",
}

_NULLS = "nulls AS (SELECT * REPLACE (CASE WHEN doc_id % 4 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 3 <> 0 THEN source END AS source) FROM cls)"
GATE_SQL["verdicts_null_groups"] = CORPUS_SQL["corpus_verdicts"].replace(CLASSIFIED_CTE, f"{CLASSIFIED_CTE}, {_NULLS}").replace("FROM cls LEFT", "FROM nulls cls LEFT")
GATE_SQL["manifest_null_groups"] = f"WITH {CLASSIFIED_CTE}, {_NULLS}" + GATE_SQL["dataset_manifest"].split(CLASSIFIED_CTE)[1].replace("FROM cls", "FROM nulls")
GATE_SQL["build_diff"] = f"""
WITH {DEDUPED_CTE},
other AS (SELECT doc_id, CASE WHEN doc_id % 89 = 7 THEN text || ' ' ELSE text END AS text FROM dd WHERE doc_id % 97 <> 5
          UNION ALL SELECT doc_id + 1000000000, text FROM dd WHERE doc_id % 211 = 3),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, coalesce(a.doc_id, b.doc_id) AS k, a.text AS x, b.text AS y FROM dd a FULL JOIN other b ON a.doc_id = b.doc_id)
SELECT k // 64 * 64 AS low, k // 64 * 64 + 63 AS high, count(a) AS n_left, count(b) AS n_right,
       count(*) FILTER (WHERE b IS NULL) AS missing, count(*) FILTER (WHERE a IS NULL) AS added, count(*) FILTER (WHERE x <> y) AS changed
FROM j GROUP BY ALL HAVING count(*) FILTER (WHERE a IS NULL OR b IS NULL OR x <> y) > 0"""

GATE_SQL["dataset_digest"] = f"""
WITH {DEDUPED_CTE},
h AS (SELECT sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(text) || ':' || text, '-')) AS rh FROM dd)
SELECT count(*) AS n_rows, sha256(count(*)::VARCHAR || {" || ".join(f"':' || coalesce(sum(('0x' || substr(rh, {1 + 15 * i}, 15))::BIGINT::HUGEINT), 0)::VARCHAR" for i in range(5))}) AS digest
FROM h"""

GATE_SQL["wet_roundtrip"] = f"""
WITH {CLASSIFIED_CTE}
SELECT 'doc://' || source || '/' || doc_id::VARCHAR AS uri, content_hash, strlen(norm_text)::BIGINT AS n_bytes
FROM cls WHERE reason = 'passed'"""

TOKEN_SQL["packed_shards"] = TOKEN_SQL["pack_bytes"]

GATE_SQL["published_versions"] = f"""
WITH {DEDUPED_CTE},
n AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE doc_id % 2 = 0) AS n_even FROM dd)
SELECT step::INTEGER AS step, kind, v AS version, CASE WHEN v = 'v1' THEN n_even ELSE n_rows END AS n_rows
FROM n, (VALUES (1, 'datasets', 'v1'), (2, 'datasets', 'v2'), (2, 'models', 'v1'), (3, 'datasets', 'v1')) AS t(step, kind, v)"""

TOKEN_SQL["epoch_shards"] = f"""
WITH {DEDUPED_CTE},
p AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(doc_id::VARCHAR || ':1'), doc_id) - 1 AS pos FROM dd)
SELECT doc_id, 1 AS epoch, (pos % 8)::INTEGER AS shard, (pos // 8 // 4)::BIGINT AS batch FROM p"""

_BOILERPLATE_BODY = "repeat(array_to_string([" + ", ".join(_q(x) for x in K.BOILERPLATE_LINES) + "], chr(10)) || chr(10), 2)"

# Rules of plans/archives_q.py written in SQL: 250 ids an archive, the form by doc_id % 10, every fifth archive unreadable.
ARCHIVES_CTE = f"""
wraw AS (SELECT doc_id, lang, (doc_id // 250)::VARCHAR AS source, (doc_id // 250) % 5 = 3 AS bad,
                CASE WHEN doc_id % 10 = 5 THEN '' ELSE 'doc://' || doc_id::VARCHAR END AS uri,
                CASE doc_id % 10 WHEN 3 THEN 'About WARC/1.0 records. ' || text WHEN 7 THEN {_BOILERPLATE_BODY}
                  WHEN 8 THEN repeat('ab', 40) || repeat(' ', 60) || repeat('ab', 40)
                  WHEN 9 THEN 'e' || chr(769) || chr(9) || chr(9) || 'x' || repeat(chr(10), 4) || text ELSE text END AS text
         FROM documents WHERE doc_id % 10 NOT IN (1, 6)),
wdocs AS (SELECT * FROM wraw WHERE NOT bad AND {sql_strip('text')} <> ''),
{CLASSIFIED_CTE.strip().replace('FROM documents', 'FROM wdocs')}"""

ARCHIVE_SQL: dict[str, str] = {
    "archive_inventory": """
SELECT doc_id // 250 AS archive, (doc_id // 250) % 5 <> 3 AS readable, true AS has_checksum, true AS has_bytes
FROM documents GROUP BY 1""",
    "raw_inventory": """
WITH a AS (SELECT DISTINCT doc_id // 250 AS archive FROM documents),
r AS (SELECT 'https://archives.example/archive-' || archive || '.wet.gz' AS source_url, 1 AS file_count FROM a
      UNION ALL SELECT '*' AS source_url, count(*) AS file_count FROM a HAVING count(*) > 0)
SELECT 'common_crawl' AS source_name, 'CL-2026-01' AS crawl_id, 'https://commoncrawl.org/terms-of-use/' AS license, source_url,
       file_count::BIGINT AS file_count, true AS complete FROM r""",
    "archive_documents": f"""
WITH {ARCHIVES_CTE}
SELECT uri, content_hash, strlen(norm_text)::BIGINT AS n_bytes FROM cls JOIN wdocs USING (doc_id) WHERE reason = 'passed'""",
    "archive_stats": f"""
WITH {ARCHIVES_CTE},
k AS (SELECT source::BIGINT AS archive, CASE WHEN reason = 'passed' THEN reason ELSE 'rejected_' || reason END AS reason FROM cls)
SELECT archive, reason, count(*) AS n FROM k GROUP BY ALL
UNION ALL SELECT archive, 'total' AS reason, count(*) AS n FROM k GROUP BY archive
UNION ALL SELECT DISTINCT doc_id // 250 AS archive, 'rejected_malformed' AS reason, 1 AS n FROM documents WHERE (doc_id // 250) % 5 = 3""",
}
