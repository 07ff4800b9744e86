"""Queries through the engine's calls: functions as bodies, futures, detached work, groups, and whole recipes."""

from __future__ import annotations

import functools

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom import api
from blockloom.control import BULK, DYNAMIC, FIXED_REDUCE, KAHAN_REDUCE, LATENCY, STATIC, CancellationToken, Deadline
from blockloom.engine import Engine, EngineGroup
from blockloom.operators.blocks import with_index
from blockloom.plans import chain
from blockloom.queries import core
from blockloom.storage import scratch, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = functools.partial(core.query, queries=QUERIES, oracles=ORACLES)

_money = lambda c: F.col(c).cast("decimal(18,2)")


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return with_index(events, "event_id"), events.count()


def _gain(block: pa.Table) -> pa.Table:
    return pa.table({"event_id": block["event_id"], "sample": pc.multiply(block["value"], 0.5)})


@query("SELECT event_id, value * 0.5 AS sample FROM events")
def engine_map_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain for each sample: a function over blocks in order, dealt out by a dynamic policy."""
    indexed, n = _events(spark, sf_dir)
    with Engine(spark, 4) as engine:
        return api.map_blocks(engine, indexed, n, _gain, "event_id long, sample double", policy=DYNAMIC)


@query("SELECT event_id, value * 0.5 AS sample FROM events")
def engine_map_async(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as an expression, in the background; the future ends with the rows written."""
    indexed, n = _events(spark, sf_dir)
    with Engine(spark, 4) as engine:
        return api.sync_wait(engine.map_blocks_async(indexed, n, [F.col("event_id"), (F.col("value") * 0.5).alias("sample")], policy=STATIC))


_NPV = "row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS idx, l_extendedprice / (1.0::DOUBLE + 0.05::DOUBLE * (year(l_shipdate) - 1990)) AS v"


@query(core._tree_sql(f"SELECT {_NPV} FROM lineitem", core._KAHAN, leaf="struct_pack(s := p, c := 0.0::DOUBLE)", last="a[1].s", name="npv"))
def engine_reduce_npv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted cash flows of a book: the same bits for any number of participants."""
    keys = "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_shipdate".split()
    lines = table(spark, sf_dir, "lineitem").select(*keys)
    with Engine(spark) as engine:
        flow = F.col("l_extendedprice") / (F.lit(1.0) + F.lit(0.05) * (F.year("l_shipdate") - 1990))
        npv = api.reduce(engine, with_index(lines, *keys), flow, lines.count(), policy=KAHAN_REDUCE)
    return spark.createDataFrame([(npv,)], "npv double")


@query("SELECT sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def engine_fork_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three reductions side by side, joined."""
    indexed, n = core._orders(spark, sf_dir)
    with Engine(spark, 4) as engine:
        price = F.col("o_totalprice")
        found = api.fork_join(engine, lambda: float(engine.reduce(indexed, _money("o_totalprice"), n)), lambda: engine.reduce(indexed, price, n, op="min"), lambda: engine.reduce(indexed, price, n, op="max"), policy=LATENCY)
    return spark.createDataFrame([tuple(found)], "total double, least double, most double")


@query("SELECT n_regionkey AS region, count(*) AS nations FROM nation GROUP BY n_regionkey")
def engine_fork_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call for each of five regions."""
    nations = table(spark, sf_dir, "nation")
    with Engine(spark, 4) as engine:
        found = engine.fork_join_all(5, lambda k: (k, nations.where(F.col("n_regionkey") == k).count()))
    return spark.createDataFrame(found, f"region {nations.schema['n_regionkey'].dataType.simpleString()}, nations long")


@query("SELECT sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders")
def engine_reduce_async(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, n = core._orders(spark, sf_dir)
    with Engine(spark) as engine:
        total = api.sync_wait(engine.reduce_async(indexed, _money("o_totalprice"), n, policy=FIXED_REDUCE))
    return spark.createDataFrame([(float(total),)], "total double")


@query("SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (ORDER BY o_orderkey, o_totalprice ROWS UNBOUNDED PRECEDING)::DOUBLE AS running FROM orders")
def engine_scan_async(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, n = core._orders(spark, sf_dir)
    with Engine(spark) as engine:
        scanned = api.sync_wait(engine.scan_async(indexed, _money("o_totalprice"), n, name="running", policy=BULK))
    return scanned.select("o_orderkey", F.col("running").cast("double").alias("running"))


_IMAGES = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


@query(f"""
WITH r AS (SELECT vec_id, list_transform(range(1, 33), lambda k: (embedding[2 * k - 1]::DOUBLE + embedding[2 * k]::DOUBLE) / 2) AS px FROM embeddings WHERE {_IMAGES}),
n AS (SELECT vec_id, px, list_max(list_transform(px, lambda x: abs(x))) AS top FROM r)
SELECT vec_id, (k - 1)::INTEGER AS at, CASE WHEN top = 0 THEN 0.0 ELSE px[k] / top END AS v FROM n, range(1, 33) t(k)""")
def engine_chain_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resize, normalise to [-1, 1] and emit: two stages that end at a barrier of all slots, and one that does not."""
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    images = table(spark, sf_dir, "embeddings").where((F.size("embedding") == 64) & clean).select("vec_id", F.col("embedding").cast("array<double>").alias("px"))
    pairs = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda k: (F.element_at("px", k * 2 - 1) + F.element_at("px", k * 2)) / 2)
    top = F.array_max(F.transform("px", F.abs))
    unit = F.transform("px", lambda x: F.when(top == 0, 0.0).otherwise(x / top))
    stages = [
        chain.global_stage("resize", lambda df, _: df.withColumn("px", pairs)),
        chain.make_stage(chain.Barrier.GLOBAL, lambda df, _: df.withColumn("px", unit), "normalise"),
        chain.static_stage("emit", lambda df, _: df),
    ]
    with Engine(spark, 4) as engine:
        out = api.chain(engine, with_index(images, "vec_id"), images.count(), stages)
        return out.select("vec_id", F.posexplode("px").alias("at", "v"))


@query("SELECT p_partkey, ((p_retailprice::DECIMAL(18,2) + 1) * 2)::DOUBLE AS price FROM part")
def engine_chain_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain with a token that does not stop, in the background: all its stages count."""
    parts, n = core._parts(spark, sf_dir)
    change = lambda f: lambda df, _: df.withColumn("price", f(F.col("price")).cast("decimal(20,2)"))
    stages = [chain.global_stage("add", change(lambda p: p + 1)), chain.static_stage("scale", change(lambda p: p * 2))]
    with Engine(spark, 4) as engine:
        out = api.sync_wait(engine.chain_async(parts, n, stages, token=CancellationToken.owned()))
    return out.select("p_partkey", F.col("price").cast("double").alias("price"))


@query("SELECT p_partkey, p_retailprice::DECIMAL(18,2)::DOUBLE AS price FROM part")
def engine_chain_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token that has stopped before the chain begins: no stage runs, the rows are as they came."""
    parts, n = core._parts(spark, sf_dir)
    token = CancellationToken.owned()
    token.request_stop()
    with Engine(spark, 4) as engine:
        out = api.chain(engine, parts, n, [chain.static_stage("zero", lambda df, _: df.withColumn("price", F.lit(0).cast("decimal(18,2)")))], token=token)
    return out.select("p_partkey", F.col("price").cast("double").alias("price"))


@query("""
WITH RECURSIVE g(step, x, prev) AS (
  SELECT 0, list(s * 1000 ORDER BY s), list(s * 1000 ORDER BY s) FROM (SELECT n_nationkey * n_nationkey AS s FROM nation)
  UNION ALL SELECT step + 1, list_transform(range(1, len(x) + 1), lambda k: CASE WHEN k = 1 OR k = len(x) THEN x[k]
    ELSE 2 * x[k] - prev[k] + (x[greatest(k - 1, 1)] - 2 * x[k] + x[least(k + 1, len(x))]) // 4 END), x FROM g WHERE step < 6)
SELECT (k - 1)::BIGINT AS particle, x[k]::BIGINT AS x FROM g, unnest(range(1, len(x) + 1)) t(k) WHERE step = 6""")
def engine_phases_cloth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six Verlet steps of particles on springs, the ends held fast. Each step reads the state before it alone."""
    nations = table(spark, sf_dir, "nation")
    n = nations.count()
    at = (F.col("n_nationkey") * F.col("n_nationkey") * 1000).cast("long")
    rows = nations.select(F.col("n_nationkey").cast("long").alias("particle"), at.alias("x"), at.alias("prev"))

    def step(df: DataFrame, _: int, __: object) -> DataFrame:
        sent = df.select("prev", "x", F.col("particle").alias("own"), F.explode(F.sequence(F.col("particle") - 1, F.col("particle") + 1)).alias("particle"))
        of = lambda c, shift: F.max(F.when(F.col("own") == F.col("particle") + shift, F.col(c)))
        met = sent.groupBy("particle").agg(of("x", -1).alias("l"), of("x", 0).alias("x"), of("prev", 0).alias("prev"), of("x", 1).alias("r")).where("x IS NOT NULL")
        moved = F.col("x") * 2 - F.col("prev") + F.expr("(l - 2 * x + r) div 4")
        return met.select("particle", F.when((F.col("particle") == 0) | (F.col("particle") == n - 1), F.col("x")).otherwise(moved).alias("next"), "x").select("particle", F.col("next").alias("x"), F.col("x").alias("prev"))

    with Engine(spark, 4) as engine:
        return api.sync_wait(engine.phases_async(rows, 6, step)).select("particle", "x")


def _squares(block: pa.Table) -> pa.Table:
    return pa.table({"event_id": block["event_id"], "square": pc.multiply(block["value"], block["value"])})


@query("SELECT event_id, value * value AS square FROM events")
def engine_bulk_async(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent queries in blocks, each result with its query."""
    indexed, n = _events(spark, sf_dir)
    with Engine(spark, 4) as engine:
        return api.sync_wait(engine.bulk_async(indexed, n, _squares, "event_id long, square double", policy=DYNAMIC))


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def engine_detached_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows flushed to a sink in the background; the engine's end waits for them."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "value")
    sink = scratch(spark, "flushed")
    with Engine(spark) as engine:
        api.submit_detached(engine, lambda: rows.write.parquet(sink))
    if engine.last_detached_error:
        raise engine.last_detached_error
    return spark.read.schema(rows.schema).parquet(sink)


@query("""SELECT (c_nationkey % 4)::INTEGER AS shard, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance, (SELECT sum(c_acctbal::DECIMAL(18,2)) FROM customer)::DOUBLE AS every
FROM customer GROUP BY c_nationkey % 4""")
def engine_group_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine for each shard of a column store; the shards' totals are added in their order."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    shards = [customers.where(F.col("c_nationkey") % 4 == k) for k in range(4)]
    group = EngineGroup(spark, 4)
    try:
        parts, total = group.reduce_by_shard([(with_index(s, "c_custkey"), s.count()) for s in shards], _money("c_acctbal"), init=0)
    finally:
        group.close()
    return spark.createDataFrame([(k, float(p), float(total)) for k, p in enumerate(parts)], "shard int, balance double, every double")


@query("SELECT 5 AS depth, count(*) AS found FROM orders WHERE o_orderkey % 32 = 0")
def engine_deepening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that deepens five times under one token; no deadline falls, so the deepest counts."""
    indexed, n = core._orders(spark, sf_dir)
    with Engine(spark, 4) as engine:
        search = lambda depth, token: (depth, engine.reduce(indexed, (F.col("o_orderkey") % (1 << depth) == 0).cast("long"), n, init=0, token=token, waves=2))
        return spark.createDataFrame([engine.deepening(search, limit=5, deadline=Deadline())], "depth int, found long")
