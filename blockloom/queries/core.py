"""Queries of the ordered operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.control import DYNAMIC_CHAIN
from blockloom.operators import bulk, kernels
from blockloom.operators.blocks import block_of, chunk_size, slot_bounds, slot_of, with_index
from blockloom.operators.reduce import divergence, folded_partials, kahan_within, reduce_blocks, tree
from blockloom.operators.scan import compact, scan_blocks, scan_with
from blockloom.plans import chain, recurse
from blockloom.storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LEVELS = 6


def query(sql: str | None, queries: dict = QUERIES, oracles: dict = ORACLES) -> Callable[[Callable], Callable]:
    """Register a query under its function's name, with its DuckDB text."""

    def add(fn: Callable) -> Callable:
        queries[fn.__name__] = fn
        if sql:
            oracles[fn.__name__] = sql
        return fn

    return add


def _money(c: str):
    return F.col(c).cast("decimal(18,2)")


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return with_index(orders, "o_orderkey", "o_totalprice"), orders.count()


_IDX = "row_number() OVER (ORDER BY o_orderkey, o_totalprice) - 1"


_FOLD = "list_reduce(list_prepend(0.0::DOUBLE, list(v ORDER BY idx)), lambda x, y: x + y)"


def _tree_sql(rows: str, node: str, leaf: str = "p", last: str = "a[1]", name: str = "value", chunk: str = "greatest(1, (count(*) + 63) // 64)", fold: str = _FOLD) -> str:
    """DuckDB text of the fixed-block fold over rows (idx, v) and the tree above it; node combines a[2k+1] and a[2k+2]."""
    levels = ",\n".join(
        f"l{n + 1} AS (SELECT list_transform(range(0, (len(a) + 1) // 2), lambda k: CASE WHEN 2 * k + 2 <= len(a) THEN {node} ELSE a[2 * k + 1] END) AS a FROM l{n})" for n in range(LEVELS)
    )
    return f"""
WITH rows AS ({rows}
), c AS (SELECT {chunk} AS chunk FROM rows
), parts AS (SELECT idx // chunk AS b, {fold} AS p FROM rows, c GROUP BY 1
), l0 AS (SELECT list({leaf} ORDER BY b) AS a FROM parts
), {levels}
SELECT {last} AS "{name}" FROM l{LEVELS}"""


_ADD = "a[2 * k + 1] + a[2 * k + 2]"
_KAHAN = """list_transform(list_transform(list_transform([struct_pack(l := a[2 * k + 1], r := a[2 * k + 2])],
  lambda p: struct_pack(s0 := p.l.s, y1 := p.r.s - p.l.c, rc := p.r.c)),
  lambda q: struct_pack(t1 := q.s0 + q.y1, c1 := ((q.s0 + q.y1) - q.s0) - q.y1, rc := q.rc)),
  lambda r: struct_pack(s := r.t1 + (-r.rc - r.c1), c := ((r.t1 + (-r.rc - r.c1)) - r.t1) - (-r.rc - r.c1)))[1]"""


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def map_block_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body that is an expression: one narrow stage over three columns."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


_KAHAN_FOLD = """list_reduce(list_prepend(struct_pack(s := 0.0::DOUBLE, c := 0.0::DOUBLE), list(struct_pack(s := v, c := 0.0::DOUBLE) ORDER BY idx)),
  lambda x, y: struct_pack(s := x.s + (y.s - x.c), c := ((x.s + (y.s - x.c)) - x.s) - (y.s - x.c))).s"""


@query(f"""
WITH i AS (SELECT {_IDX} AS idx FROM orders), n AS (SELECT count(*) AS n FROM orders),
b AS (SELECT 'dynamic' AS kind, idx // greatest(1, (n + 7) // 8) AS part, idx FROM i, n
  UNION ALL SELECT 'static', idx // greatest(1, (n + 3) // 4), idx FROM i, n
  UNION ALL SELECT 'slot', ((idx + 1) * 4 - 1) // n, idx FROM i, n)
SELECT kind, part::BIGINT AS part, min(idx) AS lo, max(idx) + 1 AS hi, count(*) AS n_rows FROM b GROUP BY kind, part""")
def block_partition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and slots of four participants: bounds, and every index once."""
    indexed, n = _orders(spark, sf_dir)
    kinds = [F.struct(F.lit(k).alias("kind"), block_of(F.col("idx"), chunk_size(n, 4, balance=k)).alias("part")) for k in ("dynamic", "static")]
    kinds.append(F.struct(F.lit("slot").alias("kind"), slot_of(F.col("idx"), n, 4).cast("long").alias("part")))
    parts = indexed.select("idx", F.explode(F.array(*kinds)).alias("p"))
    return parts.groupBy("p.kind", "p.part").agg(F.min("idx").alias("lo"), (F.max("idx") + 1).alias("hi"), F.count("*").alias("n_rows"))


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(_tree_sql(f"SELECT row_number() OVER (ORDER BY {_LINE}) - 1 AS idx, l_extendedprice * (1 - l_discount) AS v FROM lineitem", _ADD, name="revenue"))
def reduce_fixed_block_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of doubles in fixed blocks, in the order of all columns: the same bits for any partitioning."""
    lines = table(spark, sf_dir, "lineitem")
    keys = _LINE.split(", ")
    return reduce_blocks(with_index(lines.select(*keys), *keys), F.col("l_extendedprice") * (1 - F.col("l_discount")), lines.count(), name="revenue")


@query(_tree_sql(f"SELECT {_IDX} AS idx, o_totalprice AS v FROM orders", _ADD, name="total"))
def reduce_fixed_block_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, n = _orders(spark, sf_dir)
    return reduce_blocks(indexed, F.col("o_totalprice"), n, name="total")


@query(_tree_sql(f"SELECT {_IDX} AS idx, o_totalprice AS v FROM orders", _KAHAN, leaf="struct_pack(s := p, c := 0.0::DOUBLE)", last="a[1].s", name="total"))
def reduce_kahan_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, n = _orders(spark, sf_dir)
    return reduce_blocks(indexed, F.col("o_totalprice"), n, determinism="kahan", name="total")


@query(_tree_sql(f"SELECT {_IDX} AS idx, o_totalprice AS v FROM orders", _KAHAN, leaf="struct_pack(s := p, c := 0.0::DOUBLE)", last="a[1].s", name="total", chunk="max(4096)", fold=_KAHAN_FOLD))
def reduce_kahan_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compensated within blocks too."""
    indexed, n = _orders(spark, sf_dir)
    return kahan_within(indexed, F.col("o_totalprice"), n, name="total")


@query("SELECT (1000 + sum(o_totalprice::DECIMAL(18,2)))::DOUBLE AS total, min(o_totalprice) AS least, greatest(0, max(o_totalprice)) AS greatest_or_zero FROM orders")
def reduce_init_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """init is combined once, whatever the number of blocks."""
    indexed, n = _orders(spark, sf_dir)
    total = reduce_blocks(indexed, _money("o_totalprice"), n, init=F.lit(1000), chunk=97, name="total").select(F.col("total").cast("double").alias("total"))
    least = reduce_blocks(indexed, F.col("o_totalprice"), n, op="min", name="least")
    most = reduce_blocks(indexed, F.col("o_totalprice"), n, op="max", init=F.lit(0.0), name="greatest_or_zero")
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(total).join(one(least), "__one").join(one(most), "__one").drop("__one")


@query("SELECT coalesce(42.0 + sum(o_totalprice), 42.0)::DOUBLE AS total FROM orders WHERE o_orderkey < 0")
def reduce_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing to reduce gives init."""
    none = table(spark, sf_dir, "orders").where("o_orderkey < 0").select("o_orderkey", "o_totalprice")
    return reduce_blocks(with_index(none, "o_orderkey"), F.col("o_totalprice"), none.count(), init=F.lit(42.0), name="total")


@query("SELECT sum(1 + (i & 63))::BIGINT AS total FROM range(1000000) t(i)")
def reduce_cycle64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 + (i & 63) over a million indexes."""
    return reduce_blocks(spark.range(1_000_000).withColumnRenamed("id", "idx"), 1 + F.col("idx").bitwiseAND(F.lit(63)), 1_000_000, name="total")


#: Costs of a Pareto distribution: a fifth of the rows has four fifths of the mass.
_PARETO_SQL = "least(200000, floor(540 / pow(1 - (({0}) * 1103515245 + 12345) % 2147483648 / 2147483648.0::DOUBLE, 1 / 1.16::DOUBLE)))::BIGINT"


def _pareto(i):
    u = (i * 1103515245 + 12345) % 2147483648 / F.lit(2147483648.0)
    return F.least(F.lit(200_000), F.floor(540 / F.pow(1 - u, F.lit(1 / 1.16)))).cast("long")


@query(f"SELECT count(*) AS n, sum({_PARETO_SQL.format('i')})::BIGINT AS total FROM range(1000000) t(i)")
def reduce_pareto_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A million skewed costs. They are whole numbers, so tasks fold their own rows, however the mass lies."""
    indexed = spark.range(1_000_000).withColumnRenamed("id", "idx")
    return reduce_blocks(indexed, _pareto(F.col("idx")), 1_000_000, name="total").select(F.lit(1_000_000).cast("long").alias("n"), "total")


@query("SELECT i, (" + " + ".join(_PARETO_SQL.format(f"i + {k} * 2048") for k in range(7)) + ")::BIGINT AS total FROM range(2048) t(i)")
def chain_pareto_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven stages, each adding its own skewed cost, between barriers that deal the rows out anew."""
    rows = spark.range(2048).select(F.col("id").alias("idx"), F.lit(0).cast("long").alias("total"))
    stages = [chain.global_stage(f"cost {k}", lambda df, k: df.withColumn("total", F.col("total") + _pareto(F.col("idx") + k * 2048))) for k in range(7)]
    return chain.run_chain(rows, 2048, stages, participants=8, policy=DYNAMIC_CHAIN).select(F.col("idx").alias("i"), "total")


@query("SELECT string_agg(n_name, '>' ORDER BY n_nationkey) AS names FROM nation")
def reduce_concat_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An associative combiner that is not commutative keeps the order."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    join = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit(">"), b))
    parts = folded_partials(with_index(nations, "n_nationkey", "n_name"), F.col("n_name"), 3, F.lit(""), join)
    return tree(parts, -(-nations.count() // 3), join).select(F.col("p").alias("names"))


@query("SELECT 6::BIGINT AS runs, 0.0::DOUBLE AS divergent_pct")
def reduce_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed-block sum under other partitionings: no run's bits differ from the first's."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    n = orders.count()
    runs = [reduce_blocks(with_index(orders.repartition(p, "o_orderkey"), "o_orderkey", "o_totalprice"), F.col("o_totalprice"), n, name="value").select(F.lit(k).alias("run"), "value") for k, p in enumerate((1, 3, 7, 2, 5, 16))]
    return divergence(recurse.union_all(runs)).select(F.lit(len(runs)).cast("long").alias("runs"), "divergent_pct")


@query("SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (ORDER BY o_orderkey, o_totalprice ROWS UNBOUNDED PRECEDING)::DOUBLE AS running FROM orders")
def scan_inclusive_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, n = _orders(spark, sf_dir)
    return scan_blocks(indexed, _money("o_totalprice"), n, name="running").select("o_orderkey", F.col("running").cast("double").alias("running"))


@query("""SELECT event_id, coalesce(sum(length(props)) OVER w, 0)::BIGINT AS begins, coalesce(max(value) OVER w, 0.0) AS top_before
FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def scan_exclusive_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each event's text would begin in one buffer, and the greatest value before it."""
    events = table(spark, sf_dir, "events").select("event_id", "value", F.length("props").alias("size"))
    indexed, n = with_index(events, "event_id"), events.count()
    begins = scan_blocks(indexed, F.col("size").cast("long"), n, exclusive=True, identity=F.lit(0), chunk=4096, name="begins")
    return scan_blocks(begins, F.col("value"), n, op="max", exclusive=True, identity=F.lit(0.0), chunk=4096, name="top_before").select("event_id", "begins", "top_before")


@query("SELECT n_nationkey, string_agg(n_name, '') OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS names FROM nation")
def scan_concat_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    indexed = with_index(nations, "n_nationkey", "n_name")
    scanned = scan_with(indexed, "n_name", nations.count(), lambda a, b: a + b, chunk=4, name="names")
    return indexed.join(scanned, "idx").select("n_nationkey", "names")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS slot, value FROM events WHERE event_type = 'purchase'")
def compact_filter_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept rows and their output slots."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return compact(events, F.col("event_type") == "purchase", "event_id").select("event_id", "slot", "value")


@query("""SELECT (c_nationkey % 4)::INTEGER AS shard, count(*) AS customers, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance,
sum(sum(c_acctbal::DECIMAL(18,2))) OVER (ORDER BY c_nationkey % 4)::DOUBLE AS so_far FROM customer GROUP BY c_nationkey % 4""")
def shard_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shard by itself, then an ordered combine of the few shard totals."""
    customers = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 4).alias("shard"), "c_acctbal")
    shards = bulk.shard_aggregate(customers, "shard", F.count("*").alias("customers"), F.sum(_money("c_acctbal")).cast("decimal(28,2)").alias("balance"))
    so_far = F.sum("balance").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    return shards.withColumn("so_far", so_far.cast("double")).withColumn("balance", F.col("balance").cast("double"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
d AS (SELECT a.vec_id AS q, b.vec_id AS r, list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
m AS (SELECT q, arg_min(r, (d, r)) AS r, min(d) AS d FROM d GROUP BY q)
SELECT e.vec_id AS query_id, m.r AS nearest_id, round(m.d, 9) AS distance2 FROM embeddings e LEFT JOIN m ON m.q = e.vec_id""")
def bulk_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's nearest other vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return bulk.nearest(vectors, vectors).withColumn("distance2", F.round("distance2", 9))


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def bulk_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return bulk.lookup(orders, customers, "o_custkey").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    parts = table(spark, sf_dir, "part").select("p_partkey", _money("p_retailprice").alias("price"))
    return with_index(parts, "p_partkey"), parts.count()


@query("SELECT p_partkey, ((p_retailprice::DECIMAL(18,2) + 1) * 2 - 3)::DOUBLE AS price FROM part")
def chain_three_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages without barriers are one narrow plan."""
    parts, n = _parts(spark, sf_dir)
    change = lambda f: lambda df, _: df.withColumn("price", f(F.col("price")).cast("decimal(20,2)"))
    stages = [chain.static_stage("add", change(lambda p: p + 1)), chain.static_stage("scale", change(lambda p: p * 2)), chain.static_stage("take", change(lambda p: p - 3))]
    return chain.run_chain(parts, n, stages, participants=4).select("p_partkey", F.col("price").cast("double").alias("price"))


@query("SELECT p_partkey, ((p_partkey * 3 + 21) % 1000)::BIGINT AS v FROM part")
def chain_seven_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven fused stages: + k for k in 0 to 6, after a scale and before a fold into a thousand."""
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 3).alias("v"))
    stages = [chain.static_stage(f"add {k}", lambda df, k: df.withColumn("v", F.col("v") + k)) for k in range(7)]
    out = chain.run_chain(with_index(parts, "p_partkey"), parts.count(), stages, participants=8)
    return out.select("p_partkey", (F.col("v") % 1000).alias("v"))


@query("""
WITH i AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, count(*) OVER () AS n FROM supplier)
SELECT s_suppkey, CASE WHEN ((idx + 1) * 4 - 1) // n = 0 THEN '012' ELSE '02' END AS stages FROM i""")
def chain_serial_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the serial stage the next one runs on slot 0's rows alone, and only the next one."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    log = lambda df, k: df.withColumn("stages", F.concat("stages", F.lit(str(k))))
    stages = [chain.serial_stage("first", log), chain.static_stage("gated", log), chain.static_stage("all", log)]
    indexed = with_index(suppliers, "s_suppkey").withColumn("stages", F.lit(""))
    return chain.run_chain(indexed, suppliers.count(), stages, participants=4).select("s_suppkey", "stages")


@query("""SELECT p_partkey, (p_retailprice::DECIMAL(18,2) * 2)::DOUBLE AS price,
((p_retailprice::DECIMAL(18,2) * 2)::DECIMAL(20,2) > (SELECT sum(p_retailprice::DECIMAL(18,2) * 2) / count(*) FROM part)) AS above FROM part""")
def chain_reduce_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage, its reduction over all slots, and a stage that uses it."""
    parts, n = _parts(spark, sf_dir)

    def compare(df: DataFrame, _: int) -> DataFrame:
        total = reduce_blocks(df.select("idx", "price"), F.col("price"), n, name="total")  # one row
        return df.drop("above").crossJoin(F.broadcast(total)).withColumn("above", F.col("price").cast("double") > F.col("total").cast("double") / n).select(df.columns)

    double = lambda df, _: df.withColumn("price", (F.col("price") * 2).cast("decimal(20,2)"))
    rows = parts.withColumn("above", F.lit(False))
    return chain.run_chain(rows, n, [chain.reduce_stage("double", double), chain.static_stage("compare", compare)], participants=4).select("p_partkey", F.col("price").cast("double").alias("price"), "above")


@query("""
WITH RECURSIVE b AS (SELECT (event_id // 100)::BIGINT AS cell, (sum(value::DECIMAL(18,2)) * 1000)::BIGINT AS v FROM events GROUP BY 1),
g(phase, cells) AS (SELECT 0, list(v ORDER BY cell) FROM b
  UNION ALL SELECT phase + 1, list_transform(range(1, len(cells) + 1), lambda k: (cells[greatest(k - 1, 1)] + 2 * cells[k] + cells[least(k + 1, len(cells))]) // 4) FROM g WHERE phase < 5)
SELECT (k - 1)::BIGINT AS cell, cells[k] AS v FROM g, unnest(range(1, len(cells) + 1)) t(k) WHERE phase = 5""")
def phases_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five smoothing phases over neighbouring cells; all cells end a phase before the next begins."""
    events = table(spark, sf_dir, "events")
    cells = events.groupBy(F.floor(F.col("event_id") / 100).alias("cell")).agg((F.sum(_money("value")) * 1000).cast("long").alias("v"))

    def smooth(rows: DataFrame, phase: int, _: object) -> DataFrame:
        sent = rows.select(F.explode(F.array(F.struct((F.col("cell") - 1).alias("to"), F.lit(1).alias("side")), F.struct(F.col("cell").alias("to"), F.lit(0).alias("side")), F.struct((F.col("cell") + 1).alias("to"), F.lit(-1).alias("side")))).alias("m"), "v")
        side = lambda s: F.max(F.when(F.col("m.side") == s, F.col("v")))
        met = sent.groupBy(F.col("m.to").alias("cell")).agg(side(-1).alias("l"), side(0).alias("own"), side(1).alias("r")).where("own IS NOT NULL")
        return met.select("cell", F.expr("(coalesce(l, own) + 2 * own + coalesce(r, own)) div 4").alias("v"))

    return chain.run_phases(cells, 5, smooth, cut_every=2)


@query("""
WITH n AS (SELECT count(*) AS n FROM events), s AS (SELECT i AS slot, n * i // 8 AS lo, n * (i + 1) // 8 AS hi FROM range(8) t(i), n)
SELECT slot::INTEGER AS slot, p::INTEGER AS phase, (p * 1000)::BIGINT AS observed, (hi - lo)::BIGINT AS n_rows FROM s, range(10) t(p)""")
def phases_prehook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the hook sets before a phase is what every slot sees in it."""
    n = table(spark, sf_dir, "events").count()
    bounds = spark.createDataFrame([(s, hi - lo) for s, (lo, hi) in enumerate(slot_bounds(n, 8))], "slot int, n_rows long")
    rows = bounds.withColumn("seen", F.array().cast("array<long>"))
    seen = chain.run_phases(rows, 10, lambda df, p, hook: df.withColumn("seen", F.concat("seen", F.array(F.lit(hook).cast("long")))), pre_phase=lambda p: p * 1000)
    return seen.select("slot", F.posexplode("seen").alias("phase", "observed"), "n_rows")


@query("SELECT slot::INTEGER AS slot, (slot + 30 * 31 // 2)::BIGINT AS v FROM range(16) t(slot)")
def phases_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty phases over sixteen slots; each adds its number, so the value has a closed form."""
    slots = spark.range(16).select(F.col("id").cast("int").alias("slot"), F.col("id").alias("v"))
    return chain.run_phases(slots, 30, lambda df, p, _: df.withColumn("v", F.col("v") + p + 1))


@query("""
WITH RECURSIVE s(label, depth) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT label * 10 + c, depth + 1 FROM s, range(10) t(c) WHERE depth < 6)
SELECT 6 AS depth, count(*) AS leaves, sum(label)::BIGINT AS total FROM s WHERE depth = 6""")
def recurse_skynet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurse.skynet(spark, 6, 10)


@query("WITH RECURSIVE f(n, a, b) AS (SELECT 0, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 28) SELECT n, a AS fib FROM f")
def recurse_fib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurse.fibonacci(spark, 28)


@query("""
WITH RECURSIVE q(depth, cols) AS (SELECT 0, []::INTEGER[] UNION ALL
  SELECT depth + 1, list_append(cols, c::INTEGER) FROM q, range(8) t(c) WHERE depth < 8
    AND len(list_filter(range(1, depth + 1), lambda r: cols[r] = c OR abs(cols[r] - c) = depth + 1 - r)) = 0)
SELECT 8 AS n, count(*) AS solutions FROM q WHERE depth = 8""")
def recurse_queens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurse.queens(spark, 8)


@query("""
WITH RECURSIVE q(depth, cols) AS (SELECT 0, []::INTEGER[] UNION ALL
  SELECT depth + 1, list_append(cols, c::INTEGER) FROM q, range(12) t(c) WHERE depth < 12
    AND len(list_filter(range(1, depth + 1), lambda r: cols[r] = c OR abs(cols[r] - c) = depth + 1 - r)) = 0)
SELECT 12 AS n, count(*) AS solutions FROM q WHERE depth = 12""")
def recurse_queens_twelve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurse.queens(spark, 12)


@query("""
WITH RECURSIVE items AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS k, 1 + (n_nationkey * 37) % 100 AS w, 1 + (n_nationkey * 53) % 100 AS v FROM nation),
b(k, best) AS (SELECT 0, list_transform(range(0, 601), lambda c: 0::BIGINT)
  UNION ALL SELECT b.k + 1, list_transform(range(0, 601), lambda c: greatest(best[c + 1], CASE WHEN c >= w THEN best[c + 1 - w] + v ELSE 0 END)) FROM b JOIN items ON items.k = b.k + 1)
SELECT 600::BIGINT AS capacity, best[601]::BIGINT AS best FROM b ORDER BY k DESC LIMIT 1""")
def recurse_knapsack(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", (1 + (F.col("n_nationkey") * 37) % 100).alias("weight"), (1 + (F.col("n_nationkey") * 53) % 100).alias("value"))
    return recurse.knapsack(nations, 600, key="n_nationkey", weight="weight", value="value")


@query("""
WITH RECURSIVE items AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS k, 1 + (n_nationkey * 37) % 100 AS w, 1 + (n_nationkey * 53) % 100 AS v FROM nation),
b(k, best) AS (SELECT 0, list_transform(range(0, 601), lambda c: 0::BIGINT)
  UNION ALL SELECT b.k + 1, list_transform(range(0, 601), lambda c: greatest(best[c + 1], CASE WHEN c >= w THEN best[c + 1 - w] + v ELSE 0 END)) FROM b JOIN items ON items.k = b.k + 1)
SELECT 600::BIGINT AS capacity, best[601]::BIGINT AS best FROM b ORDER BY k DESC LIMIT 1""")
def recurse_knapsack_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same best value by a search that bounds prune."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", (1 + (F.col("n_nationkey") * 37) % 100).alias("weight"), (1 + (F.col("n_nationkey") * 53) % 100).alias("value"))
    return recurse.knapsack_search(nations, 600, key="n_nationkey", weight="weight", value="value").drop("branches")


@query("""
WITH RECURSIVE t(depth, state) AS (SELECT 0, unhex(sha1(unhex(repeat('0', 32) || lpad(hex(19), 8, '0'))))
  UNION ALL SELECT depth + 1, unhex(sha1(unhex(hex(state) || lpad(hex(c), 8, '0')))) FROM (
    SELECT depth, state, unnest(range(floor(ln(1 - (('0x' || right(hex(state), 8))::BIGINT & 2147483647) / 2147483648.0::DOUBLE) / ln(1 - 1 / (1 + 4.0::DOUBLE)))::BIGINT)) AS c FROM t WHERE depth < 10))
SELECT depth, count(*) AS nodes FROM t GROUP BY depth""")
def recurse_geometric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unbalanced tree of 4,130,071 nodes, level by level."""
    return recurse.geometric_tree(spark)


@query("SELECT n_nationkey, i::INTEGER AS i, (n_nationkey * 10 + i)::BIGINT AS cell FROM nation, range(10) t(i) WHERE i <= n_regionkey")
def nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map inside a map: one flat expansion of both indexes."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return recurse.fan_out(nations, F.col("n_regionkey") + 1, "i").select("n_nationkey", F.col("i").cast("int").alias("i"), (F.col("n_nationkey") * 10 + F.col("i")).cast("long").alias("cell"))


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position, o_orderkey, o_totalprice FROM orders")
def sort_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return with_index(orders, "o_totalprice", "o_orderkey", name="position")


@query("""
WITH t AS (SELECT vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64)
SELECT x.d AS i, y.d AS j, round(sum(x.v * y.v), 6) + 0.0 AS v FROM t x JOIN t y USING (vec_id) GROUP BY x.d, y.d""")
def matmul_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of the vectors' transposed matrix with itself."""
    vectors = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    cells = vectors.select(F.col("vec_id").alias("k"), F.posexplode("embedding").alias("i", "v"))
    product = kernels.matmul(cells.select("i", "k", "v"), cells.select("k", F.col("i").alias("j"), "v"))
    return product.select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query("""
WITH RECURSIVE s(k, x) AS (SELECT 0, (792321 * 1664525::BIGINT + 1013904223) % 4294967296 UNION ALL SELECT k + 1, (x * 1664525 + 1013904223) % 4294967296 FROM s WHERE k < 255),
g(step, a) AS (SELECT 0, list((x >> 12) / 1048576.0::DOUBLE ORDER BY k) FROM s
  UNION ALL SELECT step + 1, list_transform(range(0, 256), lambda p: CASE WHEN p // 16 BETWEEN 1 AND 14 AND p % 16 BETWEEN 1 AND 14
    THEN 0.25::DOUBLE * (a[p - 15] + a[p + 17] + a[p] + a[p + 2]) ELSE a[p + 1] END) FROM g WHERE step < 5)
SELECT (p // 16)::BIGINT AS i, (p % 16)::INTEGER AS j, a[p + 1] AS v FROM g, range(256) t(p) WHERE step = 5""")
def stencil_heat_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five heat steps on a generated grid of 16 by 16 cells."""
    return kernels.heat(kernels.lcg_grid(spark, 16, 0xC1701), 16, 5).select("i", F.posexplode("cells").alias("j", "v"))
