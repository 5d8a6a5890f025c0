"""DuckDB twins of the run-analytics queries, with the derivation rules of ``sources/derived.py``
written again in SQL."""

from __future__ import annotations

from corpuslab.functions import constants as K

# The derivation rules, written out a second time.
TRAINING_INSTANCE = {
    "AUTOMOBILE": "g5.xlarge",
    "BUILDING": "g5.12xlarge",
    "FURNITURE": "p3.8xlarge",
    "HOUSEHOLD": "p4d.24xlarge",
    "MACHINERY": "trn1.2xlarge",
}
INFERENCE_INSTANCE = {
    "AUTOMOBILE": "g5.xlarge",
    "BUILDING": "g5.2xlarge",
    "FURNITURE": "p3.2xlarge",
    "HOUSEHOLD": "p3.8xlarge",
    "MACHINERY": "p4d.24xlarge",
}
GPUS_PER_NODE = {"g5.xlarge": 1, "g5.12xlarge": 4, "p3.8xlarge": 4, "p4d.24xlarge": 8, "trn1.2xlarge": 1}
GPU_MODEL = {
    "p3.2xlarge": "V100",
    "p3.8xlarge": "V100",
    "p3.16xlarge": "V100",
    "p4d.24xlarge": "A100",
    "p4de.24xlarge": "A100",
    "p5.48xlarge": "H100",
}
OP_NAMES = [
    "aten::mm",
    "ncclKernel_AllReduce",
    "aten::addmm",
    "ncclKernel_AllGather",
    "aten::softmax",
    "aten::layer_norm",
    "aten::gelu",
]
MODEL_PARAMS = 355_000_000
EXPORT_FILES = ["config.json", "model.safetensors", "tokenizer.json", "export_manifest.json"]


def _q(s) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def _case(col: str, mapping: dict, cast: str = "") -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {(_q(v) if isinstance(v, str) else repr(v))}{cast}" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


def _values(mapping: dict, k: str, v: str) -> str:
    rows = ", ".join(f"({_q(a)}, {b}::DOUBLE)" for a, b in mapping.items())
    return f"(SELECT * FROM (VALUES {rows}) t({k}, {v}))"


REQUESTS = """requests AS (
  SELECT 'run-' || user_id::VARCHAR AS run_name, user_id, event_id AS request_id, ts,
         CAST(value AS DECIMAL(12,2)) * 0.01 AS latency_sec,
         (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) * 16 AS tokens_generated,
         CASE WHEN event_type = 'error' THEN 'request failed' END AS error
  FROM events)"""

SUMMARY = """
s AS (SELECT run_name, count(*) AS total_requests, count(*) FILTER (WHERE error IS NULL) AS successful,
             count(*) FILTER (WHERE error IS NOT NULL) AS failed,
             coalesce(sum(tokens_generated) FILTER (WHERE error IS NULL), 0)::BIGINT AS total_tokens_generated,
             sum(latency_sec) AS lat_sum
      FROM requests GROUP BY run_name),
s2 AS (SELECT *, round(lat_sum * 0.125, 2)::DOUBLE AS total_time_sec FROM s),
r AS (SELECT run_name, latency_sec, row_number() OVER (PARTITION BY run_name ORDER BY latency_sec, request_id) - 1 AS pos
      FROM requests WHERE error IS NULL),
p AS (SELECT s2.run_name,
             max(CASE WHEN r.pos = s2.successful // 2 THEN round(r.latency_sec, 3)::DOUBLE END) AS p50,
             max(CASE WHEN r.pos = floor(s2.successful * 0.95) THEN round(r.latency_sec, 3)::DOUBLE END) AS p95,
             max(CASE WHEN r.pos = floor(s2.successful * 0.99) THEN round(r.latency_sec, 3)::DOUBLE END) AS p99
      FROM s2 JOIN r USING (run_name) GROUP BY s2.run_name),
sm AS (SELECT run_name, total_requests, successful, failed, total_time_sec, total_tokens_generated,
              round(total_tokens_generated::DOUBLE / nullif(total_time_sec, 0), 1) AS aggregate_tokens_per_sec,
              round(successful::DOUBLE / nullif(total_time_sec, 0), 2) AS requests_per_sec,
              coalesce(p50, 0.0) AS latency_p50_sec, coalesce(p95, 0.0) AS latency_p95_sec, coalesce(p99, 0.0) AS latency_p99_sec
       FROM s2 LEFT JOIN p USING (run_name))"""

STEPS = """st AS (
  SELECT 'run-' || user_id::VARCHAR AS run_name, user_id, event_id, epoch_us(ts) AS ts_us,
         (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) * 1024 AS tokens,
         CASE WHEN event_type = 'error' THEN 'NaN'::DOUBLE ELSE value / 50.0 END AS loss,
         event_type = 'purchase' AS saved
  FROM events)"""

CUSTOMERS = f"""cu AS (
  SELECT c_custkey AS user_id, {_case('c_mktsegment', TRAINING_INSTANCE)} AS instance_type,
         {_case('c_mktsegment', INFERENCE_INSTANCE)} AS inference_instance_type,
         c_nationkey % 2 + 1 AS num_nodes
  FROM customer)"""

RUNS = f"""{STEPS}, {CUSTOMERS},
pr AS (SELECT run_name, user_id, count(*) AS total_steps, sum(tokens)::BIGINT AS total_tokens,
              (max(ts_us) - min(ts_us))::DOUBLE / 1000000.0 AS total_time_sec FROM st GROUP BY run_name, user_id),
runs AS (SELECT pr.run_name, pr.user_id, cu.instance_type,
                coalesce({_case('cu.instance_type', GPUS_PER_NODE)}, 1) AS gpus_per_node,
                coalesce({_case('cu.instance_type', GPUS_PER_NODE)}, 1) * coalesce(cu.num_nodes, 1) AS world_size,
                total_time_sec, total_steps, total_tokens,
                total_tokens::DOUBLE / nullif(total_time_sec, 0) AS final_tokens_per_sec, 0::BIGINT AS resumed_from_step
         FROM pr LEFT JOIN cu USING (user_id)),
evals AS (SELECT run_name, exp(arg_max(loss, ts_us)) AS perplexity FROM st WHERE NOT isnan(loss) GROUP BY run_name),
exports AS (SELECT 'run-' || o_custkey::VARCHAR AS run_name, count(*) AS artifact_file_count FROM orders GROUP BY o_custkey),
summ AS (SELECT runs.*, evals.perplexity,
                (total_time_sec / 3600.0::DOUBLE) * world_size AS gpu_hours,
                ((total_time_sec / 3600.0::DOUBLE) * world_size) * ({_case('instance_type', K.INSTANCE_HOURLY_PRICES, '::DOUBLE')} / gpus_per_node) AS estimated_cost_usd
         FROM runs LEFT JOIN evals USING (run_name) LEFT JOIN exports USING (run_name))"""

CHECKPOINTS = """ck AS (
  SELECT 'run-' || o_custkey::VARCHAR AS run_name,
         'runs/run-' || o_custkey::VARCHAR || '/checkpoint-' || o_orderkey::VARCHAR AS path,
         o_orderkey AS step, o_orderpriority IN ('1-URGENT', '2-HIGH') AS sharded, o_orderstatus AS st,
         o_orderpriority <> '5-LOW' AS in_manifest,
         sha256(o_orderkey::VARCHAR) AS checksum,
         sha256(o_orderkey::VARCHAR || CASE WHEN o_orderstatus = 'P' THEN '-changed' ELSE '' END) AS actual_checksum
  FROM orders),
ckv AS (SELECT *, CASE WHEN sharded THEN st <> 'O' ELSE st <> 'O' AND checksum = actual_checksum END AS valid FROM ck)"""

TELEMETRY_MEANS = """tl AS (
  SELECT 'i-' || user_id::VARCHAR AS instance_id, make_timestamp(epoch_us(ts) // 120) AS ts,
         CAST(CAST(value AS DECIMAL(12,2)) * 100 AS BIGINT) // 5 AS cents FROM events),
m AS (SELECT instance_id, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n, sum(cents)::BIGINT AS sum_cents
      FROM tl GROUP BY ALL)"""

OPS = f"""ka AS (
  SELECT 'run-' || l_suppkey::VARCHAR AS run_name,
         {[x for x in OP_NAMES]}[l_linenumber] || '/' || l_returnflag || l_linestatus AS key,
         sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS cuda_time_us,
         sum(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(4,2))) AS cpu_time_us,
         count(*) AS calls
  FROM lineitem GROUP BY ALL)"""

_prompts = "[" + ", ".join(_q(p) for p in K.PROMPTS) + "]"
_apis = ", ".join(f"({_q(k)}, {v}::DOUBLE)" for k, v in K.API_PRICES_PER_1M.items())

RUN_SQL: dict[str, str] = {
    "latency_summary": f"WITH {REQUESTS}, {SUMMARY} SELECT * FROM sm",
    "inference_cost": f"""
WITH {REQUESTS}, {SUMMARY}, {CUSTOMERS},
typed AS (SELECT sm.*, cu.inference_instance_type AS instance_type
          FROM sm JOIN (SELECT DISTINCT run_name, user_id FROM requests) u USING (run_name) JOIN cu USING (user_id)),
base AS (SELECT run_name, instance_type, pr.cost_per_hour, aggregate_tokens_per_sec AS tps
         FROM typed JOIN {_values(K.INFERENCE_COST_PER_HOUR, 'instance_type', 'cost_per_hour')} pr USING (instance_type)
         WHERE pr.cost_per_hour <> 0 AND aggregate_tokens_per_sec <> 0),
c AS (SELECT *, (cost_per_hour / 3600.0::DOUBLE) / tps * 1000000.0::DOUBLE AS c1m FROM base),
apis AS (SELECT * FROM (VALUES {_apis}) t(api, api_cost_per_1m))
SELECT run_name, instance_type, cost_per_hour, round(c1m, 4) AS self_hosted_cost_per_1m_tokens, api, api_cost_per_1m,
       round(c1m / api_cost_per_1m * 100, 1) AS breakeven_utilization_pct, c1m < api_cost_per_1m AS cheaper_self_hosted
FROM c, apis""",
    "round_robin": f"""
WITH {REQUESTS},
r AS (SELECT run_name, request_id, (row_number() OVER (PARTITION BY run_name ORDER BY request_id) - 1) % {len(K.PROMPTS)} AS i FROM requests)
SELECT run_name, request_id, i::INTEGER AS prompt_index, {_prompts}[i + 1] AS prompt FROM r""",
    "running_throughput": f"""
WITH {STEPS},
x AS (SELECT run_name, row_number() OVER w AS step, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens_processed,
             (ts_us - min(ts_us) OVER (PARTITION BY run_name))::DOUBLE / 1000000.0 AS elapsed_sec
      FROM st WINDOW w AS (PARTITION BY run_name ORDER BY ts_us, event_id))
SELECT run_name, step, tokens_processed, elapsed_sec, tokens_processed::DOUBLE / nullif(elapsed_sec, 0) AS tokens_per_sec,
       step % 10 = 0 AS logged FROM x""",
    "nonfinite_guard": f"""
WITH {STEPS}
SELECT run_name, count(*) FILTER (WHERE isnan(loss) OR isinf(loss)) AS bad_rows,
       min(ts_us) FILTER (WHERE isnan(loss) OR isinf(loss)) AS first_bad_ts_us
FROM st GROUP BY run_name""",
    "run_report": f"""
WITH {RUNS},
b AS (SELECT instance_type, min(user_id) AS user_id FROM summ GROUP BY instance_type),
lf AS (SELECT run_name, user_id, instance_type, unnest([
         {{'metric': 'gpu_hours', 'v': gpu_hours::DOUBLE}}, {{'metric': 'tokens_per_sec', 'v': final_tokens_per_sec::DOUBLE}},
         {{'metric': 'cost_usd', 'v': estimated_cost_usd::DOUBLE}}, {{'metric': 'perplexity', 'v': perplexity::DOUBLE}},
         {{'metric': 'resumed_from_step', 'v': resumed_from_step::DOUBLE}}]) AS m FROM summ),
cur AS (SELECT run_name, user_id, instance_type, m.metric AS metric, m.v AS v FROM lf),
base AS (SELECT cur.instance_type, cur.metric, cur.v FROM cur JOIN b USING (instance_type, user_id))
SELECT cur.run_name, cur.metric, round(base.v, 2) AS baseline, round(cur.v, 2) AS current, round(cur.v - base.v, 2) + 0.0::DOUBLE AS delta
FROM cur LEFT JOIN base ON cur.instance_type IS NOT DISTINCT FROM base.instance_type AND cur.metric = base.metric""",
    "fleet_cost": f"""
WITH {CUSTOMERS},
i AS (SELECT DISTINCT 'i-' || user_id::VARCHAR AS instance_id, user_id FROM events),
g AS (SELECT cu.instance_type, count(*) AS n FROM i LEFT JOIN cu USING (user_id) GROUP BY cu.instance_type)
SELECT instance_type, n, n * {_case('instance_type', K.INSTANCE_HOURLY_PRICES, '::DOUBLE')} AS hourly_cost,
       n * {_case('instance_type', K.INSTANCE_HOURLY_PRICES, '::DOUBLE')} * 24 AS daily_cost FROM g""",
    "mfu": f"""
WITH {RUNS},
g AS (SELECT run_name, world_size, final_tokens_per_sec,
             coalesce({_case('instance_type', GPU_MODEL)}, {_q(K.DEFAULT_GPU_MODEL)}) AS gpu_model FROM runs),
t AS (SELECT *, {_case('gpu_model', K.GPU_TFLOPS, '::DOUBLE')} * world_size AS theoretical_tflops,
             final_tokens_per_sec * {6 * MODEL_PARAMS} / 1e12 AS achieved FROM g)
SELECT run_name, gpu_model, world_size AS gpu_count, theoretical_tflops, round(achieved, 1) AS achieved_tflops,
       round(achieved / theoretical_tflops * 100, 1) AS mfu_percent FROM t""",
    "profile_breakdown": f"""
WITH {OPS},
g AS (SELECT run_name, sum(cuda_time_us) AS tot, coalesce(sum(cuda_time_us) FILTER (WHERE lower(key) LIKE '%nccl%'), 0) AS comm
      FROM ka GROUP BY run_name)
SELECT run_name, (tot * 0.001)::DOUBLE AS total_cuda_time_ms, (comm * 0.001)::DOUBLE AS nccl_time_ms,
       ((tot - comm) * 0.001)::DOUBLE AS compute_time_ms,
       CASE WHEN tot > 0 THEN round(comm::DOUBLE / tot::DOUBLE * 100, 1) ELSE 0.0 END AS nccl_percent,
       CASE WHEN tot > 0 THEN round((tot::DOUBLE - comm::DOUBLE) / tot::DOUBLE * 100, 1) ELSE 0.0 END AS compute_percent
FROM g""",
    "top_ops": f"""
WITH {OPS},
r AS (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY cuda_time_us DESC, key) AS rank FROM ka)
SELECT run_name, rank::INTEGER AS rank, key AS name, (cuda_time_us * 0.001)::DOUBLE AS cuda_time_ms,
       (cpu_time_us * 0.001)::DOUBLE AS cpu_time_ms, calls FROM r WHERE rank <= 10""",
    "scaling_efficiency": """
WITH sc AS (SELECT l_returnflag AS suite, 'g' || l_linenumber::VARCHAR AS config, l_linenumber AS config_order,
                   l_linenumber AS num_gpus, CASE WHEN count(*) % 7 = 0 THEN 1 ELSE 0 END AS exit_code, sum(l_quantity) AS tps
            FROM lineitem GROUP BY l_returnflag, l_linenumber),
b AS (SELECT DISTINCT ON (suite) suite, tps AS b_tps, num_gpus AS b_gpus FROM sc WHERE exit_code = 0
      ORDER BY suite, CASE WHEN num_gpus = 1 THEN 0 ELSE 1 END, config_order)
SELECT sc.suite, config, num_gpus, exit_code,
       CASE WHEN b.suite IS NULL THEN NULL WHEN exit_code <> 0 OR tps = 0 THEN 0.0 ELSE round(tps / nullif(b_tps, 0), 2) END AS speedup,
       CASE WHEN b.suite IS NULL THEN NULL WHEN exit_code <> 0 OR tps = 0 THEN 0.0
            ELSE round((tps / nullif(b_tps, 0)) / (num_gpus::DOUBLE / b_gpus) * 100, 1) END AS scaling_efficiency
FROM sc LEFT JOIN b USING (suite)""",
    "gpu_means": f"""
WITH {TELEMETRY_MEANS}
SELECT instance_id, window_start, n, sum_cents, sum_cents::DOUBLE / n / 100.0 AS mean_value FROM m""",
    "idle_alarm": f"""
WITH {TELEMETRY_MEANS},
l AS (SELECT instance_id, window_start, sum_cents < n * {int(round(K.ALARM_THRESHOLD * 100))} AS low FROM m),
x AS (SELECT *, lag(low, 1) OVER w AS l1, lag(low, 2) OVER w AS l2, lag(window_start, 1) OVER w AS s1,
             lag(window_start, 2) OVER w AS s2
      FROM l WINDOW w AS (PARTITION BY instance_id ORDER BY window_start))
SELECT instance_id, window_start FROM x
WHERE low AND l1 AND l2 AND epoch(window_start) - epoch(s1) = 300 AND epoch(window_start) - epoch(s2) = 600""",
    "latest_checkpoint": f"""
WITH {CHECKPOINTS}
SELECT run_name, arg_max(path, step) AS path, max(step) AS step FROM ckv WHERE valid GROUP BY run_name""",
    "retention": f"""
WITH {CHECKPOINTS}
SELECT run_name, step, row_number() OVER (PARTITION BY run_name ORDER BY step DESC) > 3 AS expired FROM ck""",
    "rank_agreement": """
WITH r AS (SELECT l_orderkey AS checkpoint, CASE WHEN l_returnflag = 'N' THEN l_orderkey ELSE l_orderkey - 1 END AS step FROM lineitem)
SELECT checkpoint, count(*) AS n_ranks, count(DISTINCT step) = 1 AS agreed,
       CASE WHEN count(DISTINCT step) = 1 THEN min(step) ELSE 0 END AS step
FROM r GROUP BY checkpoint""",
    "integrity_check": f"""
WITH {CHECKPOINTS},
man AS (SELECT path, checksum FROM ck WHERE NOT sharded AND in_manifest),
obs AS (SELECT path, actual_checksum AS checksum FROM ck WHERE NOT sharded AND st <> 'O')
SELECT coalesce(man.path, obs.path) AS path,
       CASE WHEN obs.path IS NULL THEN 'missing' WHEN man.path IS NULL THEN 'unlisted'
            WHEN man.checksum = obs.checksum THEN 'ok' ELSE 'corrupt' END AS status
FROM man FULL OUTER JOIN obs ON man.path = obs.path""",
}


_EXPORT_FILES = "[" + ", ".join(_q(f) for f in EXPORT_FILES) + "]"
LISTING = f"""{CHECKPOINTS},
ls AS (SELECT path AS artifact, unnest(list_filter(['meta.json',
              CASE WHEN sharded AND st <> 'O' THEN 'model/__0_0.distcp' END,
              CASE WHEN sharded AND st <> 'O' THEN 'train_state.pt' END,
              CASE WHEN NOT sharded AND st <> 'O' THEN 'state.pt' END], lambda x: x IS NOT NULL)) AS rel_path FROM ck
       UNION ALL
       SELECT 's3://models/run-' || o_custkey::VARCHAR AS artifact, unnest({_EXPORT_FILES}) AS rel_path
       FROM (SELECT DISTINCT o_custkey FROM orders))"""

RUN_SQL["artifact_index"] = f"""
WITH {LISTING}
SELECT artifact, count(*) AS n_files, string_agg(rel_path, ',' ORDER BY rel_path) AS files FROM ls GROUP BY artifact"""
RUN_SQL["artifact_kind"] = f"""
WITH {LISTING},
k AS (SELECT artifact, bool_or(split_part(rel_path, '/', -1) = 'state.pt') AS s,
             bool_or(split_part(rel_path, '/', -1) = 'config.json') AS c FROM ls GROUP BY artifact)
SELECT artifact, CASE WHEN s AND NOT c THEN 'raw_checkpoint' ELSE 'serveable' END AS kind FROM k"""

RUN_SQL["log_progress"] = """
WITH n AS (SELECT 'run-' || user_id::VARCHAR AS run_name, count(*) AS steps FROM events GROUP BY user_id)
SELECT run_name, (steps // 10 * 10)::BIGINT AS last_step, (steps // 10)::BIGINT AS n_logged FROM n WHERE steps >= 10"""


REPORT_LABELS_SQL = """CASE metric WHEN 'gpu_hours' THEN 'GPU hours to passing checkpoint' WHEN 'tokens_per_sec' THEN 'Tokens/sec'
  WHEN 'cost_usd' THEN 'Cost per trained model (USD)' WHEN 'perplexity' THEN 'Perplexity'
  WHEN 'resumed_from_step' THEN 'Resumed from step' END"""

_NUMBERED = f"""{STEPS},
sn AS (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY ts_us, event_id) AS step FROM st)"""


def _digits(c: str) -> str:
    return f"coalesce(printf('%.2f', {c}), 'n/a')"


RUN_SQL.update({
    "report_lines": f"""
SELECT run_name, metric, '| ' || {REPORT_LABELS_SQL} || ' | ' || {_digits('baseline')} || ' | ' || {_digits('"current"')}
       || ' | ' || {_digits('delta')} || ' |' AS line
FROM ({RUN_SQL['run_report']})""",
    "token_cost": f"""
WITH {RUNS}
SELECT run_name, total_tokens, estimated_cost_usd / nullif(total_tokens::DOUBLE, 0) * 1000000.0::DOUBLE AS usd_per_million_tokens FROM summ""",
    "loss_spikes": f"""
WITH {_NUMBERED},
x AS (SELECT run_name, step, CASE WHEN NOT isnan(loss) THEN CAST(round(loss * 10000) AS BIGINT) END AS x FROM sn),
w AS (SELECT *, count(x) OVER v AS n, sum(x) OVER v AS s, sum(x * x) OVER v AS q FROM x
      WINDOW v AS (PARTITION BY run_name ORDER BY step ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT run_name, step, x / 10000.0::DOUBLE AS loss, n AS n_before, s::DOUBLE / n / 10000.0::DOUBLE AS mean_before FROM w
WHERE n >= 10 AND n * x > s AND (n * x - s)::DOUBLE * (n * x - s)::DOUBLE * (n - 1) > (n * q - s * s)::DOUBLE * n * 9""",
    "stalls": f"""
WITH {_NUMBERED},
g AS (SELECT run_name, step, ts_us, lead(ts_us) OVER (PARTITION BY run_name ORDER BY step) - ts_us AS gap FROM sn)
SELECT run_name, step, ts_us AS stall_start_us, gap::DOUBLE / 1000000.0::DOUBLE AS gap_sec FROM g WHERE gap > 86400000000""",
    "lost_work": f"""
WITH {_NUMBERED},
c AS (SELECT run_name, step FROM sn WHERE isnan(loss)), k AS (SELECT run_name, step FROM sn WHERE saved)
SELECT c.run_name, c.step AS crash_step, coalesce(k.step, 0) AS checkpoint_step, c.step - coalesce(k.step, 0) AS lost_steps
FROM c ASOF LEFT JOIN k ON c.run_name = k.run_name AND c.step >= k.step""",
    "step_timing": """
WITH s AS (SELECT 'run-' || l_suppkey::VARCHAR AS run_name, CAST(l_quantity AS DECIMAL(12,2)) AS f,
                  CAST(l_extendedprice AS DECIMAL(15,2)) AS b FROM lineitem)
SELECT run_name, count(*) AS steps, sum(f)::DOUBLE / count(*) AS avg_forward_ms, sum(b)::DOUBLE / count(*) AS avg_backward_ms,
       sum(f + b)::DOUBLE / count(*) AS avg_total_ms, sum(f + b)::DOUBLE AS total_ms
FROM s GROUP BY run_name""",
    "replay": f"""
WITH {CHECKPOINTS}
SELECT l.path, l.run_name, l.file_index, l.checksum AS listed_checksum, o.actual_checksum AS raw_checksum_sha256
FROM (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY step) - 1 AS file_index FROM ck WHERE NOT sharded AND in_manifest) l
LEFT JOIN (SELECT path, actual_checksum FROM ck WHERE NOT sharded AND st <> 'O') o ON l.path = o.path""",
    "lineage": f"""
WITH {RUNS}, {CHECKPOINTS},
d AS (SELECT source AS dataset_version, count(*) AS n_docs FROM documents GROUP BY source),
nw AS (SELECT run_name, arg_max(path, step) AS checkpoint_path FROM ckv WHERE valid GROUP BY run_name),
ev AS (SELECT checkpoint_path, perplexity <= 90.0 AS passed FROM nw JOIN evals USING (run_name)),
pb AS (SELECT checkpoint_path, 's3://models/' || run_name AS storage_location FROM nw JOIN exports USING (run_name)
       JOIN ev USING (checkpoint_path) WHERE passed)
SELECT d.dataset_version, n_docs, r.run_name AS run_id, nw.checkpoint_path, ev.passed, pb.storage_location
FROM d LEFT JOIN (SELECT run_name, 'src' || (user_id % 25)::VARCHAR AS dv FROM runs) r ON r.dv = d.dataset_version
LEFT JOIN nw ON nw.run_name = r.run_name LEFT JOIN ev ON ev.checkpoint_path = nw.checkpoint_path
LEFT JOIN pb ON pb.checkpoint_path = nw.checkpoint_path""",
    "artifact_digest": f"""
WITH {LISTING}
SELECT artifact, 'sha256:' || sha256(string_agg(rel_path || chr(9) || sha256(artifact || '/' || rel_path), chr(10) ORDER BY rel_path))
       AS artifact_checksum, count(*) AS artifact_file_count, sum(strlen(artifact || '/' || rel_path))::BIGINT AS artifact_size_bytes
FROM ls GROUP BY artifact""",
    "log_metrics": f"""
WITH {_NUMBERED}
SELECT run_name, max(step) AS last_step, arg_max(round(loss, 4), step) AS last_loss, 1e-4::DOUBLE AS last_lr,
       arg_max(tokens, step)::DOUBLE AS last_tokens_per_sec, 900.0::DOUBLE AS last_gpu_mem_mb, NULL::BIGINT AS resumed_from_step
FROM sn WHERE step % 10 = 0 GROUP BY run_name""",
})

STREAM_SQL: dict[str, str] = {
    "stream_gpu_means": f"""
WITH {TELEMETRY_MEANS}
SELECT instance_id, window_start, n, sum_cents, sum_cents::DOUBLE / n / 100.0 AS mean_value FROM m
WHERE window_start + INTERVAL 5 MINUTE <= date_trunc('millisecond', (SELECT max(ts) FROM tl)) - INTERVAL 10 MINUTE""",
    "stream_idle_alarm": f"""
WITH r AS (SELECT 'i-' || user_id::VARCHAR AS instance_id, epoch_us(ts) // 120 AS us, event_id,
                  CAST(CAST(value AS DECIMAL(12,2)) * 100 AS BIGINT) // 5 AS cents FROM events),
a AS (SELECT *, us + event_id % 4 * 150000000 AS due FROM r),
d AS (SELECT *, (due - (SELECT min(due) FROM a)) * 6 // (SELECT max(due) - min(due) + 1 FROM a) AS part FROM a),
c AS (SELECT instance_id, make_timestamp(us) AS ts, cents FROM d WHERE NOT (event_id % 53 = 7 AND part < 2)),
m AS (SELECT instance_id, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n, sum(cents) AS sum_cents FROM c GROUP BY ALL),
l AS (SELECT instance_id, window_start, sum_cents < n * {int(round(K.ALARM_THRESHOLD * 100))} AS low FROM m
      WHERE window_start + INTERVAL 5 MINUTE <= date_trunc('millisecond', (SELECT max(ts) FROM c)) - INTERVAL 10 MINUTE),
x AS (SELECT *, lag(low, 1) OVER w AS l1, lag(low, 2) OVER w AS l2, lag(window_start, 1) OVER w AS s1, lag(window_start, 2) OVER w AS s2
      FROM l WINDOW w AS (PARTITION BY instance_id ORDER BY window_start))
SELECT instance_id, window_start FROM x
WHERE low AND l1 AND l2 AND epoch(window_start) - epoch(s1) = 300 AND epoch(window_start) - epoch(s2) = 600""",
    "stream_step_metrics": f"""
WITH {STEPS},
x AS (SELECT run_name, loss, row_number() OVER w AS step, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens_processed,
             (ts_us - min(ts_us) OVER (PARTITION BY run_name))::DOUBLE / 1000000.0 AS elapsed_sec
      FROM st WINDOW w AS (PARTITION BY run_name ORDER BY ts_us, event_id))
SELECT run_name, step, tokens_processed, elapsed_sec, tokens_processed::DOUBLE / nullif(elapsed_sec, 0) AS tokens_per_sec,
       step % 10 = 0 AS logged, CASE WHEN isnan(loss) OR isinf(loss) THEN 'quarantine' ELSE 'steps' END AS sink FROM x""",
}
