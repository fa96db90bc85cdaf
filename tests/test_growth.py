"""What is copied, broadcast and held by a task grows no faster than the input."""

import gzip
import glob
import json
import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from routelake.operators import assemble as A
from routelake.operators import graph as G
from routelake.operators import knn_join as K
from routelake.operators import labels as L
from routelake.operators.common import planned_tasks
from routelake.operators.vectors import knn_topk
from routelake.plans import fixtures as fx
from routelake.plans import registry
from routelake.plans.q_assemble import adapted_queries, adapter_sources
from routelake.plans.q_routers import _chain
from routelake.session import ensure_checkpoint_dir, scratch_path
from routelake.sources import json_array as J

SCHEMA = "id long, v array<double>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_query_is_shipped_once_however_many_cells_it_searches(spark):
    r = np.random.RandomState(5)
    df = spark.createDataFrame([(i, r.randn(16).tolist()) for i in range(800)], SCHEMA)  # no clusters: almost every cell is searched
    q, it, dealt, cells = K.prepare(df.where("id < 50"), df, "id", "v", "id", "v", pivots=20)
    rest = K._visits(q.withColumn("floor", F.lit(-1.0)), cells, 3, False)
    assert rest.count() <= 50
    searched = sum(int(np.unpackbits(np.frombuffer(r.cells, np.uint8)).sum()) for r in rest.collect())
    assert searched > 50 * 10


def test_copies_of_a_vector_are_bounded():
    for n in (10_000, 100_000, 1_000_000, 3_000_000):
        tiles, parts = K._grid(n, 4 * n, 50, 2_000, 256, 12)
        assert tiles <= K.GRID and parts <= K.GRID
        assert n / tiles <= 1.1 * K.HELD_ROWS


def test_equal_vectors_are_equally_near_in_any_block(spark):
    """Ties go to the smaller id, also where copies stand in different blocks."""
    r = np.random.RandomState(7)
    base = [r.randn(24).tolist() for _ in range(40)]
    df = spark.createDataFrame([(i, base[i % 40]) for i in range(600)], SCHEMA)
    out = K.knn_join(df.where("id < 40"), df, 20, "id", "v", "id", "v", pivots=7, tile_rows=13, block_rows=11)
    got = {}
    for x in sorted(out.collect(), key=lambda x: (x.qid, x["rank"])):
        got.setdefault(x.qid, []).append(x.iid)
    assert all(v[:15] == [i + 40 * j for j in range(15)] for i, v in got.items()) and len(got) == 40


def test_query_degrees_are_never_broadcast(spark):
    e = spark.createDataFrame([(i // 3, 1000 + i % 3) for i in range(60)], "src long, dst long")
    out = G.degree_norm(e)
    assert "SortMergeJoin [src" in plan(out)
    assert out.count() == 60 and abs(out.first()["norm"] - (3 * 20) ** -0.5) < 1e-12


def test_grid_queries_are_spread_before_they_are_expanded(spark, sf_dir):
    assert planned_tasks(fx.f_grid_queries(spark, sf_dir)) >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_adapters_do_not_shuffle_documents_that_many_tasks_read(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("part", "conversations"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)  # a task a file
    try:
        shuffles = spark.sparkContext.defaultParallelism + 100
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        assert "RoundRobinPartitioning" not in plan(adapted_queries(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_what_a_search_shuffles_at_once_is_bounded():
    """In vectors: twice both sides, where all tiles at once took 5 to 19 times both."""
    for n, k in ((100_000, 20), (1_440_000, 20), (3_000_000, 50)):
        waves, tiles, parts = K._waves(n, 4 * n, k, 2_000, 256, 12)
        in_wave = -(-n // waves)
        assert waves > 1 and tiles * 4 * n + parts * in_wave * (1 + k / 12) <= max(K.WAVE_ROWS, 2 * 5 * n)
        assert in_wave / tiles <= 1.1 * K.HELD_ROWS and tiles * parts >= 12
    assert K._waves(10_256, 41_026, 50, 2_000, 8_000, 8)[0] == 1


def test_waves_find_what_one_search_finds(spark, monkeypatch):
    r = np.random.RandomState(11)
    rows = [(i, [0.0] * 8 if i % 97 == 0 else r.randint(-3, 4, 8).astype(float).tolist()) for i in range(700)]
    for kind in ("double", "float"):
        df = spark.createDataFrame(rows, f"id long, v array<{kind}>")
        args = (df.where("id % 5 = 0"), df, 6, "id", "v", "id", "v")
        want = {(x.qid, x.iid, round(x.sim, 12), x["rank"]) for x in knn_topk(*args).collect()}
        with monkeypatch.context() as m:
            m.setattr(K, "WAVE_ROWS", 10)
            assert K._waves(140, 700, 6, 13, 50, spark.sparkContext.defaultParallelism)[0] > 1
            assert {(x.qid, x.iid, round(x.sim, 12), x["rank"]) for x in knn_topk(*args, tile_rows=13, block_rows=50).collect()} == want
        assert len(want) == 6 * 140


def test_vectors_of_four_bytes_stay_so(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, v array<float>")
    q, it, dealt, _ = K.prepare(df.where("id < 5"), df, "id", "v", "id", "v")
    assert {dict(x.dtypes)["vec"] for x in (q, it, dealt)} == {"array<float>"}
    q, it, *_ = K.prepare(df.select("id", F.col("v").cast("array<double>").alias("v")), df, "id", "v", "id", "v")
    assert {dict(x.dtypes)["vec"] for x in (q, it)} == {"array<double>"}


def test_the_log_is_numbered_without_shuffling_its_texts(spark, sf_dir):
    assert "hashpartitioning(query_id" not in plan(fx.f_log(spark, sf_dir))


def test_candidates_are_shuffled_without_the_scores_that_follow_from_them(spark, sf_dir):
    p = plan(L.route_records(fx.f_log(spark, sf_dir)))
    assert not [x for x in p.split("collect_list(")[1:] if "score_cost" in x.split("),")[0].split("))")[0]]


def test_an_array_in_gzip_is_one_text(spark):
    df = spark.range(300).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    for rows, n in ((df, 300), (df.where("false"), 0)):
        path = scratch_path(spark, f"array-{uuid.uuid4().hex}")
        J.write_json_array(rows.repartition(3), path, "id", "gzip")
        whole = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/part-*")))
        assert [x["id"] for x in json.loads(gzip.decompress(whole))] == list(range(n))
        assert J.read_json_array(spark, path, df.schema).exceptAll(rows).count() == 0


def test_the_chain_keeps_its_array_in_gzip_and_no_log(spark, sf_dir):
    base = ensure_checkpoint_dir(spark).removeprefix("file://").rstrip("/")
    before = set(glob.glob(f"{base}/*"))
    train, test, cand = _chain(spark, sf_dir)
    new = {x for x in glob.glob(f"{base}/*") if x not in before}
    assert not [x for x in new if "/f-log-" in x]
    records = [x for x in new if "/records-" in x]
    assert len(records) == 1 and all(f.endswith(".gz") for f in glob.glob(f"{records[0]}/part-*"))
    assert train.count() > 0 and test.count() > 0 and cand.count() > test.count()


def test_documents_adapters_read_them_once_and_lay_their_rows_together(spark, tmp_path):
    r = np.random.RandomState(3)
    words = ["".join(chr(97 + c) for c in r.randint(0, 26, 7)) for _ in range(5000)]
    docs = [(i, " ".join(words[w] for w in r.randint(0, 5000, 250)) if i % 11 else None, "en") for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    d, fields, _, _, _ = adapter_sources(spark, _with_others(spark, tmp_path))
    adapters = {"squad": A.adapt_squad, "boolq": A.adapt_boolq, "gsm8k": A.adapt_gsm8k, "math": A.adapt_math, "hellaswag": A.adapt_hellaswag}
    shared = A.adapt_shared(d, {n: (fields[n], f) for n, f in adapters.items()})
    apart = A.union_sources(*[f(d.select(*fields[n])) for n, f in adapters.items()])
    assert shared.columns == apart.columns and shared.dtypes == apart.dtypes
    assert shared.exceptAll(apart).count() == 0 and apart.exceptAll(shared).count() == 0
    assert plan(shared).count("FileScan parquet") == 1
    ids = [x.source_id for x in shared.select("source_id").collect()]
    assert len(ids) == 1500 and all(len(set(ids[i:i + 5])) == 1 for i in range(0, 1500, 5))
    size = {}
    for name, df in (("shared", shared), ("apart", apart)):
        df.write.parquet(f"{tmp_path}/{name}")
        size[name] = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/{name}/*.parquet"))
    assert size["shared"] < 0.6 * size["apart"]


def _with_others(spark, tmp_path) -> str:
    spark.createDataFrame([(1, "large ring", "Brand#7", "LARGE", 1)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 0, "user", "a?"), (1, 1, "assistant", "b")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_the_routers_ranking_keeps_its_array_in_gzip_and_no_log(spark, sf_dir):
    base = ensure_checkpoint_dir(spark).removeprefix("file://").rstrip("/")
    before = set(glob.glob(f"{base}/*"))
    out = registry.QUERIES["w9_router_ranking"](spark, sf_dir)
    new = {x for x in glob.glob(f"{base}/*") if x not in before}
    assert not [x for x in new if "/f-log-" in x] and not [x for x in new if "/records-" in x and glob.glob(f"{x}/part-*.txt")]
    assert out.count() == 40
