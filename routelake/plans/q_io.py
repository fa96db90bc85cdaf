"""Registered queries: sources/sinks (S1-S13), batch jobs (B1-B6, G7, J9, J10,
T10, T11) and streaming (X1, X2).

Each I/O query writes table-derived data under a fresh folder inside
``spark.checkpoint.dir`` and reads it back, so round trips are compared with
the original tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelake.functions.numeric import judge_score
from routelake.operators import batch as B
from routelake.operators import labels as L
from routelake.operators.common import r6
from routelake.plans import fixtures as fx
from routelake.plans.fixtures_sql import R6, with_
from routelake.plans.registry import register
from routelake.session import scratch_path
from routelake.sources import io
from routelake.sources.json_array import read_json_array, write_json_array
from routelake.sources.keyed_runs import KeyedRuns
from routelake.sources.runs import RunStore
from routelake.streaming import incremental as X
from routelake.streaming import stateful as ST


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


# ---------------------------------------------------------------- S1-S4, S9
_DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                            T.StructField("lang", T.StringType())])


@register("s1_s2_csv_roundtrip", "SELECT doc_id, text, lang FROM documents")
def s1_s2_csv_roundtrip(spark, sf_dir):
    p = _scratch(spark, "docs-csv")
    io.write_csv(fx.f_txt(spark, sf_dir).select("doc_id", "text", "lang"), p)
    return io.read_csv(spark, p, _DOC_SCHEMA)


@register("s3_csv_append", "SELECT doc_id, text, lang FROM documents")
def s3_csv_append(spark, sf_dir):
    p = _scratch(spark, "docs-append")
    d = fx.f_txt(spark, sf_dir).select("doc_id", "text", "lang")
    io.write_csv(d.where(F.col("lang") == "en"), p)
    io.append_csv(d.where(F.col("lang") != "en"), p)
    return io.read_csv(spark, p, _DOC_SCHEMA)


@register("s4_suffix_reader", with_("flog") + f"SELECT query_id, llm, {R6('performance')} AS performance FROM flog")
def s4_suffix_reader(spark, sf_dir):
    p = _scratch(spark, "flog") + ".parquet"
    fx.f_log(spark, sf_dir).select("query_id", "llm", "performance").write.parquet(p)
    out = io.read_by_suffix(spark, p)
    return out.select("query_id", "llm", r6("performance").alias("performance"))


@register("s4_csv_and_json", "SELECT conv_id, turn, role, text FROM conversations")
def s4_csv_and_json(spark, sf_dir):
    """S4's other branches: user turns by way of CSV, the others by way of JSON arrays."""
    c = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    csv, js = _scratch(spark, "turns") + ".csv", _scratch(spark, "turns") + ".json"
    io.write_csv(c.where(F.col("role") == "user"), csv)
    io.write_json_arrays(c.where(F.col("role") != "user").withColumn("chunk", (F.col("conv_id") / 100).cast("bigint")), js, "chunk")
    read = lambda p: io.read_by_suffix(spark, p, c.schema).select(*c.columns)
    return read(csv).unionByName(read(js))


@register("s6_json_array", "SELECT conv_id, turn, role, text FROM conversations")
def s6_json_array(spark, sf_dir):
    """All turns as one JSON array that many tasks write and read."""
    c = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path = _scratch(spark, "turns-array")
    write_json_array(c, path, ["conv_id", "turn"])
    return read_json_array(spark, path, c.schema)


@register("j9_resume_by_filters", """
SELECT user_id, event_type FROM events GROUP BY user_id, event_type
HAVING count(*) FILTER (WHERE dayofmonth(ts) % 5 <> 0 AND event_id % 11 = 0) = 0""")
def j9_resume_by_filters(spark, sf_dir):
    """J9 on a log of five runs with key filters: the (user, type) pairs that no run has finished; the fifth day's run never came."""
    ev = fx.table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts") % 5)
    log = KeyedRuns(spark, _scratch(spark, "keyed-runs"), ["user_id", "event_type"])
    rows = ev.select("user_id", "event_type", "day", (F.col("event_id") % 11 == 0).alias("success"))
    for k in (1, 2, 3, 4):
        log.write_run(rows.where(F.col("day") == k).drop("day"), k)
    work = ev.select("user_id", "event_type").distinct()
    left, _ = log.pending(work, "success")
    return left


@register("s9_parquet_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def s9_parquet_scan(spark, sf_dir):
    li = io.read_parquet(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")
    return li.where(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_quantity")


# ---------------------------------------------------------------- S5-S8
@register("s5_s6_route_json", with_("flog") + """
SELECT query_id, count(*) AS n_candidates, min(llm) AS first_candidate FROM flog
WHERE response IS NOT NULL AND response <> '' GROUP BY query_id""")
def s5_s6_route_json(spark, sf_dir):
    rec = L.route_records(fx.f_log(spark, sf_dir)).where(F.col("scenario") == "performance")
    p = _scratch(spark, "routes")
    io.write_json_arrays(rec.select("query_id", "query", "candidates", "ground_truth",
                                    (F.col("query_id") / 200).cast("bigint").alias("chunk")), p, "chunk")
    schema = io.ROUTE_SCHEMA.add("query_id", T.LongType())
    back = io.read_route_json(spark, p, schema)
    return back.select("query_id", F.size("candidates").cast("bigint").alias("n_candidates"),
                       F.array_min(F.transform("candidates", lambda c: c["candidate_name"])).alias("first_candidate"))


_CONV_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@register("s7_s8_jsonl_gzip", "SELECT conv_id, turn, role, text FROM conversations")
def s7_s8_jsonl_gzip(spark, sf_dir):
    p = _scratch(spark, "conv-jsonl")
    c = fx.table(spark, sf_dir, "conversations")
    io.write_jsonl(c.where(F.col("role") == "user"), p, gzip=True)
    io.write_jsonl(c.where(F.col("role") != "user"), p, append=True, gzip=True)
    return io.read_jsonl(spark, p, _CONV_SCHEMA)


# ---------------------------------------------------------------- S10, S11
@register("s10_catalogue_scan", """
SELECT n_name AS llm, CAST(n_nationkey AS INTEGER) AS llm_idx, (n_regionkey + 1)::DOUBLE / 10.0 AS input_price FROM nation""")
def s10_catalogue_scan(spark, sf_dir):
    n = fx.table(spark, sf_dir, "nation")
    cat = n.select(F.col("n_name").alias("llm"), F.col("n_nationkey").alias("llm_idx"),
                   F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("llm_description"),
                   ((F.col("n_regionkey") + 1).cast("double") / 10.0).alias("input_price"),
                   ((F.col("n_regionkey") + 2).cast("double") / 10.0).alias("output_price"),
                   F.lower("n_name").alias("model"))
    p = _scratch(spark, "catalogue")
    io.write_catalogue(cat, p)
    return io.read_catalogue(spark, p).select("llm", "llm_idx", "input_price")


@register("s11_split_source", with_("flog") + "SELECT query_id, llm FROM flog WHERE split = 'test'")
def s11_split_source(spark, sf_dir):
    """The named split 'validation' is absent, so the first split ('test') is used."""
    return io.split_source(fx.f_log(spark, sf_dir), "validation").select("query_id", "llm")


@register("s11_named_split", with_("flog") + "SELECT query_id, llm FROM flog WHERE split = 'train'")
def s11_named_split(spark, sf_dir):
    return io.split_source(fx.f_log(spark, sf_dir), "train").select("query_id", "llm")


# ---------------------------------------------------------------- S12, S13
def _runs(spark, sf_dir):
    p = _scratch(spark, "runs")
    ev = fx.f_evt(spark, sf_dir).select("event_id", "user_id", "run_id", (~F.col("failed")).alias("success"))
    newest = ev.agg(F.max("run_id")).first()[0]  # every day is a run: the older ones in one pass, then the newest
    ev.where(F.col("run_id") < newest).write.mode("append").partitionBy("run_id").parquet(p)
    io.write_run(ev.where(F.col("run_id") == newest).drop("run_id"), p, newest)
    return p


@register("s12_s13_latest_run", """
SELECT event_id, user_id, NOT (event_type = 'error') AS success, CAST(dayofmonth(ts) AS INTEGER) AS run_id FROM events
WHERE dayofmonth(ts) = (SELECT max(dayofmonth(ts)) FROM events)""")
def s12_s13_latest_run(spark, sf_dir):
    return io.latest_run(spark, _runs(spark, sf_dir)).select("event_id", "user_id", "success",
                                                             F.col("run_id").cast("int").alias("run_id"))


@register("s13_latest_per_key", """
SELECT user_id, arg_max(event_id, dayofmonth(ts) * 1000000000 + event_id) AS event_id FROM events GROUP BY user_id""")
def s13_latest_per_key(spark, sf_dir):
    df = spark.read.parquet(_runs(spark, sf_dir))
    return io.latest_per_key(df, "user_id", order=("run_id", "event_id")).select("user_id", "event_id")


def _run_store(spark, sf_dir) -> RunStore:
    """Five runs (event_id mod 5) with a first try of each run that holds other rows, a run that died before its commit, a replay, and
    compaction of all but the newest two."""
    store = RunStore(spark, _scratch(spark, "run-store"))
    ev = fx.f_evt(spark, sf_dir).select("event_id", "user_id", (~F.col("failed")).alias("success"))
    of = lambda k: ev.where(F.col("event_id") % 5 == k)
    for k in (0, 1, 2):
        store.write_run(of(k).where("success").withColumn("user_id", -F.col("user_id")), k)  # first tries
    store.stage(of(4).withColumn("run_id", F.lit(9).cast("long")))  # never committed
    for k in (1, 0, 2, 3, 4, 3):  # run 3 twice: a replay
        store.write_run(of(k), k)
    store.compact(keep_newest=2)
    return store


@register("s12_committed_runs", """
SELECT event_id, user_id, NOT (event_type = 'error') AS success, event_id % 5 AS run_id FROM events""")
def s12_committed_runs(spark, sf_dir):
    return _run_store(spark, sf_dir).read().select("event_id", "user_id", "success", "run_id")


@register("s13_committed_latest", """
SELECT event_id, user_id, NOT (event_type = 'error') AS success, event_id % 5 AS run_id FROM events WHERE event_id % 5 = 4""")
def s13_committed_latest(spark, sf_dir):
    return _run_store(spark, sf_dir).latest().select("event_id", "user_id", "success", "run_id")


# ---------------------------------------------------------------- G7, J9, J10, T11
@register("g7_failure_stats", with_("fevt") + f"""
SELECT task_name, count(*) AS processed, count(*) FILTER (WHERE failed) AS failed,
       {R6('avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END)')} AS error_rate FROM fevt GROUP BY task_name""")
def g7_failure_stats(spark, sf_dir):
    ev = fx.f_evt(spark, sf_dir).withColumn("success", ~F.col("failed"))
    s = B.failure_stats(ev, by="task_name")
    return s.select("task_name", "processed", "failed", r6("error_rate").alias("error_rate"))


@register("j9_pending_work", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def j9_pending_work(spark, sf_dir):
    """Documents still to process: no successful (quality = 1) label yet."""
    work = fx.f_txt(spark, sf_dir).select("doc_id")
    done = fx.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("success"))
    return B.pending_work(work, done, "doc_id")


@register("j9_retry_failed", with_("fevt") + """
SELECT user_id FROM fevt GROUP BY user_id HAVING arg_max(failed, event_id)""")
def j9_retry_failed(spark, sf_dir):
    ev = fx.f_evt(spark, sf_dir).withColumn("success", ~F.col("failed"))
    return B.pending_work(ev.select("user_id").distinct(), ev, "user_id", retry_failed=True, order="event_id")


@register("j10_merge_results", with_("flog") + f"""
SELECT query_id, llm, {R6('coalesce(CASE WHEN query_id % 3 = 0 THEN performance END, llm_judge)')} AS llm_judge FROM flog""")
def j10_merge_results(spark, sf_dir):
    f = fx.f_log(spark, sf_dir)
    new = f.where(F.col("query_id") % 3 == 0).select("query_id", "llm", F.col("performance").alias("llm_judge"))
    out = B.merge_results(f, new, ["query_id", "llm"], "llm_judge")
    return out.select("query_id", "llm", r6("llm_judge").alias("llm_judge"))


@register("t11_judge_parse", with_("fevt", extra={"x": """
SELECT event_id, trim(regexp_extract(reply, '<answer>(.*?)</answer>', 1)) AS raw FROM fevt"""}) + """
SELECT event_id, CASE WHEN TRY_CAST(raw AS DOUBLE) IS NULL THEN NULL ELSE least(greatest(TRY_CAST(raw AS DOUBLE), 0.0), 1.0) END AS judge FROM x""")
def t11_judge_parse(spark, sf_dir):
    ev = fx.f_evt(spark, sf_dir)
    return ev.select("event_id", judge_score("reply").alias("judge"))


# ---------------------------------------------------------------- B1-B6
def flaky_call(text: str) -> str:
    """Deterministic stand-in for a remote call: fails on every 7th k."""
    k = int(text.split(":")[1])
    if k % 7 == 0:
        raise RuntimeError("service unavailable")
    return f"ok-{k * 2}"


@register("b1_fan_out", """
SELECT event_id, CASE WHEN k % 7 = 0 THEN '' ELSE 'ok-' || CAST(k * 2 AS VARCHAR) END AS output, k % 7 <> 0 AS success
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) t""")
def b1_fan_out(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("k:"), F.get_json_object("props", "$.k")).alias("req"))
    return B.fan_out(ev, flaky_call, "req").select("event_id", "output", "success")


@register("b2_b3_retry_rounds", """
SELECT count(*) AS processed, count(*) FILTER (WHERE k % 7 = 0) AS failed FROM (
  SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) t""")
def b2_b3_retry_rounds(spark, sf_dir):
    """Failed rows are retried (they fail again: the stand-in is deterministic);
    the loop stops after ``rounds`` and reports the final state (D16)."""
    ev = fx.table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("k:"), F.get_json_object("props", "$.k")).alias("req"))
    res = B.retry_rounds(ev, flaky_call, "req", "event_id", rounds=2, error_threshold=0.01)
    st = B.failure_stats(res)
    return st.select("processed", "failed")


def call_in_time(text: str, attempt: int) -> str:
    """Deterministic stand-in: every call needs k mod 4 further attempts."""
    k = int(text.split(":")[1])
    if attempt < k % 4:
        raise RuntimeError("service unavailable")
    return f"ok-{k}-{attempt}"


def _attempts_sql(rounds: int, threshold: float) -> str:
    """Final state per event: the number of rounds follows from the share that still fails after each."""
    return f"""
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
f AS (SELECT r, (SELECT avg(CASE WHEN k % 4 > r THEN 1.0 ELSE 0.0 END) FROM e) AS share FROM range(0, {rounds}) t(r)),
n AS (SELECT coalesce(min(r) FILTER (WHERE share <= {threshold}), {rounds}) AS last FROM f)
SELECT event_id, CAST(least(k % 4, last) AS INTEGER) AS attempt, k % 4 <= last AS success,
       CASE WHEN k % 4 <= last THEN 'ok-' || CAST(k AS VARCHAR) || '-' || CAST(k % 4 AS VARCHAR) ELSE '' END AS output FROM e, n"""


def _attempts(spark, sf_dir, rounds, threshold):
    ev = fx.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("k:"), F.get_json_object("props", "$.k")).alias("req"))
    res = B.retry_rounds(ev, call_in_time, "req", "event_id", rounds=rounds, error_threshold=threshold, attempt_col="attempt")
    return res.select("event_id", "attempt", "success", "output")


@register("b2_retries_that_succeed", _attempts_sql(2, 0.0))
def b2_retries_that_succeed(spark, sf_dir):
    """A first pass and two retry rounds; calls succeed at once, at the first or second retry, or not at all."""
    return _attempts(spark, sf_dir, 2, 0.0)


@register("b3_rate_gate", _attempts_sql(5, 0.6))
def b3_rate_gate(spark, sf_dir):
    """The loop ends as soon as at most 60 % fail, long before its last round."""
    return _attempts(spark, sf_dir, 5, 0.6)


def fake_judge(prompt: str) -> str:
    """Stand-in judge: a score from the response length."""
    resp = prompt.split("\nResponse: ", 1)[1].split("\n\nPlease provide", 1)[0]
    return f"<answer>{min(len(resp), 100) / 100}</answer>"


@register("b5_judge_job", with_("flog") + f"""
SELECT query_id, llm, {R6("coalesce(CASE WHEN query_id % 2 = 0 THEN llm_judge END, least(greatest(least(length(response), 100) / 100.0, 0.0), 1.0))")} AS llm_judge
FROM flog""")
def b5_judge_job(spark, sf_dir):
    f = fx.f_log(spark, sf_dir).withColumn(
        "llm_judge", F.when(F.col("query_id") % 2 == 0, F.col("llm_judge")))
    out = B.judge_job(f, fake_judge, ["query_id", "llm"])
    return out.select("query_id", "llm", r6("llm_judge").alias("llm_judge"))


def fake_batch_model(prompts: list) -> list:
    """Stand-in local model: echoes the prompt length."""
    return [f"len={len(p)}" for p in prompts]


@register("b6_batch_infer", """
SELECT conv_id, turn, 'len=' || CAST(length('<|start_header_id|>system<|end_header_id|>' || chr(10) || 'You are a helpful AI assistant. Please provide clear and accurate responses.'
  || chr(10) || '<|eot_id|>' || chr(10) || '<|start_header_id|>user<|end_header_id|>' || chr(10) || text || chr(10) || '<|eot_id|>' || chr(10)
  || '<|start_header_id|>assistant<|end_header_id|>' || chr(10)) AS VARCHAR) AS output
FROM conversations WHERE role = 'user'""")
def b6_batch_infer(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    out = B.batch_infer(B.chat_prompts(c), fake_batch_model, "prompt", batch_size=64)
    return out.select("conv_id", "turn", "output")


# ---------------------------------------------------------------- streaming
_PAIR_SCHEMA = "conv_id bigint, turn bigint, ground_truth string, prediction string, task_name string, metric string, code_pass double"


def _x1_sql():
    from routelake.plans.q_assemble import _e9_ctes
    return with_("fpair", "fcode", extra=_e9_ctes()) + f"SELECT conv_id, turn, task_name, {R6('score')} AS score FROM sc"


@register("x1_incremental_scoring", _x1_sql())
def x1_incremental_scoring(spark, sf_dir):
    """F-SCORE rows land as JSON files; a streaming query scores them one
    file per micro-batch; the result equals the batch E9 scores (same oracle)."""
    from routelake.operators.scoring import score_by_metric
    from routelake.plans.q_assemble import _scored_input
    land, sink, ck = _scratch(spark, "land"), _scratch(spark, "scored"), _scratch(spark, "ckpt-x1")
    _scored_input(spark, sf_dir).repartition(4, "task_name").write.json(land)
    score = lambda b: b.select("conv_id", "turn", "task_name",
                               score_by_metric("prediction", "ground_truth", "metric", "task_name", code_pass="code_pass").alias("score"))
    q = X.incremental_scoring(spark, land, _PAIR_SCHEMA, sink, ck, score, max_files_per_trigger=1)
    q.awaitTermination()
    return spark.read.parquet(sink).select("conv_id", "turn", "task_name", r6("score").alias("score"))


_EVT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@register("x2_streaming_window_counts", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type AS task_name, count(*) AS processed,
       count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY ALL""")
def x2_streaming_window_counts(spark, sf_dir):
    """Events streamed from parquet files; per-day, per-type counts with a
    watermark; update-mode batches are reduced to the latest value per key."""
    land, sink, ck = _scratch(spark, "evt-land"), _scratch(spark, "evt-counts"), _scratch(spark, "ckpt-x2")
    fx.table(spark, sf_dir, "events").repartition(4).write.parquet(land)
    prep = lambda s: s.select("ts", F.col("event_type").alias("task_name"),
                              (F.col("event_type") == "error").alias("failed"))
    q = X.running_counts(spark, land, _EVT_SCHEMA, sink, ck, prep, watermark="31 days", max_files_per_trigger=1)
    q.awaitTermination()
    out = X.read_running_counts(spark, sink)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "task_name",
                      "processed", "failed")


@register("x1_upserts", """
SELECT doc_id, CAST(2 - doc_id % 2 AS INTEGER) AS attempt, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS answer
FROM documents WHERE doc_id % 7 <> 6
UNION ALL SELECT doc_id, 0, 'first' FROM documents WHERE doc_id % 7 = 6""")
def x1_upserts(spark, sf_dir):
    """X1 with re-landed results: even documents are answered again (attempt 2, landed first), all but some get attempt 1, a first
    guess (attempt 0) lands last and twice; what counts is the greatest attempt. Compaction after every second batch."""
    land, sink, ck = _scratch(spark, "upsert-land"), _scratch(spark, "upserts"), _scratch(spark, "ckpt-upserts")
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    answers = lambda rows, n, a: rows.select("doc_id", F.lit(n).alias("attempt"), a.alias("answer"))
    some = d.where("doc_id % 7 <> 6")
    for landed in (answers(some.where("doc_id % 2 = 0"), 2, F.upper("lang")), answers(some, 1, F.col("lang")), answers(d, 0, F.lit("first")), answers(d, 0, F.lit("first"))):
        landed.write.mode("append").json(land)
        ST.upsert_stream(spark, land, "doc_id bigint, attempt int, answer string", sink, ck, lambda b: b, "doc_id", "attempt", compact_every=2).awaitTermination()
    return ST.read_upserts(spark, sink, "doc_id", "attempt").select("doc_id", "attempt", "answer")


@register("x2_final_windows", """
WITH e AS (SELECT event_id, ts, event_type AS task_name, event_type = 'error' AS failed, date_trunc('day', ts) AS w, event_id % 10 = 0 AS straggler FROM events),
m AS (SELECT max(ts) FILTER (WHERE NOT straggler) AS before, max(ts) AS now FROM e),
k AS (SELECT e.*, CASE WHEN straggler AND w + INTERVAL 1 DAY <= before - INTERVAL 1 DAY THEN 'late' WHEN w + INTERVAL 1 DAY <= now - INTERVAL 1 DAY THEN 'final' ELSE 'open' END AS kind FROM e, m)
SELECT kind, strftime(w, '%Y-%m-%d') AS window_start, task_name, count(*) AS processed, count(*) FILTER (WHERE failed) AS failed FROM k GROUP BY ALL""")
def x2_final_windows(spark, sf_dir):
    """X2 with a watermark that matters: the first half of the month lands, then the second, then a tenth of all events, late by then."""
    land, sink, ck = _scratch(spark, "final-land"), _scratch(spark, "final-windows"), _scratch(spark, "ckpt-final")
    ev = fx.table(spark, sf_dir, "events")
    straggler, early = F.col("event_id") % 10 == 0, F.dayofmonth("ts") <= 15
    for landed in (ev.where(~straggler & early), ev.where(~straggler & ~early), ev.where(straggler)):
        landed.write.mode("append").parquet(land)
        prep = lambda s: s.select("ts", F.col("event_type").alias("task_name"), (F.col("event_type") == "error").alias("failed"))
        ST.final_windows(spark, land, _EVT_SCHEMA, sink, ck, prep).awaitTermination()
    out = ST.read_windows(spark, sink)
    return out.select("kind", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "task_name", "processed", "failed")
