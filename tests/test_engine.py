import threading
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from blockloom import api, local
from blockloom.control import CHAIN, DYNAMIC_CHAIN, KAHAN_REDUCE, STATIC, ChainPolicy, CancellationToken, Cancelled, Deadline, Policy, PriorityGate
from blockloom.engine import Engine, EngineGroup
from blockloom.plans import chain


@pytest.fixture
def engine(spark):
    with Engine(spark, 4) as e:
        yield e


def ones(spark, n=1000):
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(1.0).alias("v"))


def test_policies():
    with pytest.raises(ValueError):
        Policy(balance="odd")
    assert Policy(estimated_item_ns=10, min_task_us=1000).inline(100, 4) and not Policy().inline(1, 1)


def test_an_engine_needs_participants(spark):
    with pytest.raises(ValueError):
        Engine(spark, 0)


def test_map_covers_each_index_once(spark, engine):
    def body(rows: pa.Table) -> pa.Table:
        return pa.table({"idx": rows.column("idx"), "block": pa.array([rows.column("idx")[0].as_py()] * rows.num_rows, pa.int64())})

    for policy, blocks in ((Policy(), 8), (STATIC, 4), (Policy(chunk=300), 4), (Policy(estimated_item_ns=1, min_task_us=1e6), 8)):
        out = engine.map_blocks(ones(spark), 1000, body, "idx long, block long", policy=policy).collect()
        assert sorted(r.idx for r in out) == list(range(1000)) and len({r.block for r in out}) == blocks
    assert engine.map_blocks(ones(spark), 1000, F.col("v") * 2).count() == 1000
    assert engine.counters()["inline_fallbacks"] == 1


def test_body_errors_surface(spark, engine):
    def fails(rows: pa.Table) -> pa.Table:
        raise ValueError("in the body")

    with pytest.raises(Exception, match="in the body"):
        engine.map_blocks(ones(spark), 1000, fails, "idx long").collect()
    with pytest.raises(ValueError, match="^in the body$"):  # the body's own error, unwrapped
        engine.map_blocks(ones(spark), 1000, fails, "idx long", now=True)


def test_methods_and_functions_agree(spark, engine):
    df = ones(spark)
    assert api.reduce(engine, df, F.col("v"), 1000, init=5.0) == engine.reduce(df, F.col("v"), 1000, init=5.0) == 1005.0
    assert engine.reduce(df, F.col("v"), 1000, policy=KAHAN_REDUCE) == 1000.0
    both = [f(df, F.col("v"), 1000).agg(F.max("scan")).first()[0] for f in (engine.scan, engine.inclusive_scan)]
    assert both == [1000.0, 1000.0] and engine.reduce(df.limit(0), F.col("v"), 0, init=42.0) == 42.0


def test_token():
    never, owned = CancellationToken(), CancellationToken.owned()
    assert not never.can_stop and not never.request_stop() and not never.stop_requested
    assert owned.can_stop and owned.request_stop() and not owned.request_stop() and owned.stop_requested


def test_stopped_before(spark, engine):
    token = CancellationToken.owned()
    token.request_stop()
    with pytest.raises(Cancelled) as e:
        engine.reduce(ones(spark), F.col("v"), 1000, init=7.0, token=token)
    assert e.value.partial_value == 7.0
    assert engine.scan(ones(spark), F.col("v"), 1000, identity=0.0, token=token).agg(F.max("scan")).first()[0] == 0.0
    assert engine.map_blocks(ones(spark), 1000, F.col("v"), token=token).count() == 0
    assert engine.fork_join(lambda: 1, lambda: 2, token=token) == [None, None]
    assert engine.counters()["cancellation_stops"] >= 4


def test_partial_value(spark, engine):
    token, calls = CancellationToken.owned(), []

    class Watching(CancellationToken):
        """Stops after the first wave."""

        @property
        def stop_requested(self):
            calls.append(1)
            return len(calls) > 1

    watching = Watching()
    watching._event = token._event
    with pytest.raises(Cancelled) as e:
        engine.reduce(ones(spark), F.col("v"), 1000, init=0.0, token=watching)
    assert 0 < e.value.partial_value < 1000
    fresh = CancellationToken.owned()
    assert engine.reduce(ones(spark), F.col("v"), 1000, init=0.0, token=fresh) == 1000.0


def test_stop_cancels_a_running_job(spark, engine):
    token = CancellationToken.owned()

    @F.udf("double")
    def slow(v):
        time.sleep(0.05)
        return v

    timer = threading.Timer(1.5, token.request_stop)
    timer.start()
    began = time.monotonic()
    with pytest.raises(Cancelled):
        engine.reduce(ones(spark, 4000), slow("v"), 4000, init=0.0, token=token)
    assert time.monotonic() - began < 30


def stopping(after):
    token = CancellationToken.owned()
    threading.Timer(after, token.request_stop).start()
    return token


def test_running_operators_are_cancelled(spark, engine):
    """Map, scan, chain, phases and bulk end without an error, with what was completed, long before they would have."""

    def slowly(rows: pa.Table) -> pa.Table:
        time.sleep(0.4)
        return rows

    sleepy = F.udf(lambda v: time.sleep(0.01) or v, "double")
    df, n = ones(spark, 4000).repartition(8), 4000
    slow_stage = chain.global_stage("slow", lambda rows, k: rows.withColumn("v", sleepy("v") + 1))
    fast_stage = chain.global_stage("fast", lambda rows, k: rows.withColumn("v", F.col("v") + 1))
    calls = {
        "map": lambda t: engine.map_blocks(df, n, slowly, "idx long, v double", policy=Policy(chunk=20), token=t).count(),
        "bulk": lambda t: engine.bulk(df, n, slowly, "idx long, v double", policy=Policy(chunk=20), token=t).count(),
        "scan": lambda t: engine.scan(df, sleepy("v"), n, identity=-1.0, token=t).agg(F.max("scan")).first()[0],
        "chain": lambda t: engine.chain(df, n, [fast_stage, slow_stage, slow_stage], token=t).agg(F.max("v")).first()[0],
        "phases": lambda t: engine.phases(df, 50, lambda rows, p, _: rows.withColumn("v", sleepy("v")), token=t).count(),
    }
    for name, call in calls.items():
        began, got = time.monotonic(), call(stopping(2.5))
        assert time.monotonic() - began < 60, name
        assert {"map": 0 <= got < n, "bulk": 0 <= got < n, "scan": got == -1.0, "chain": 1.0 <= got < 4.0, "phases": got == n}[name], (name, got)
    token = CancellationToken.owned()
    assert engine.map_blocks(df, n, lambda rows: rows, "idx long, v double", token=token).count() == n
    assert engine.chain(df, n, [fast_stage] * 3, token=token).agg(F.max("v")).first()[0] == 4.0


def test_calls_go_through_the_gate_by_priority(spark, engine):
    order, df = [], ones(spark, 10)

    def call(priority):
        policy = Policy(priority=priority)

        def body(rows):
            return rows

        engine.map_blocks(df, 10, body, "idx long, v double", policy=policy, now=True)
        order.append(priority)

    with engine._gate.admitted("throughput"):
        threads = []
        for p in ("background", "throughput", "latency"):
            threads.append(threading.Thread(target=call, args=(p,)))
            threads[-1].start()
            while not engine._gate.waiting(p):
                time.sleep(0.01)
    for t in threads:
        t.join()
    assert order == ["latency", "throughput", "background"]


def test_futures_end_with_rows_written(spark, engine):
    df, n = ones(spark, 100), 100
    futures = {
        "map": engine.map_blocks_async(df, n, lambda rows: rows, "idx long, v double"),
        "scan": engine.scan_async(df, F.col("v"), n),
        "chain": engine.chain_async(df, n, [chain.static_stage("s", lambda rows, k: rows)]),
        "phases": engine.phases_async(df, 2, lambda rows, p, _: rows),
        "bulk": engine.bulk_async(df, n, F.col("v")),
    }
    for name, future in futures.items():
        out = api.sync_wait(future)
        assert out.inputFiles() and all("/blockloom/" in f for f in out.inputFiles()) and out.count() == n, name


def test_chain_policy(spark, engine):
    df, n = ones(spark, 100), 100
    slots = lambda stages, policy: engine.chain(df, n, stages, policy=policy).select("slot").distinct().count()
    whole, mixed = [chain.global_stage("a", lambda rows, k: rows)] * 2, [chain.global_stage("a", lambda rows, k: rows), chain.static_stage("b", lambda rows, k: rows)]
    assert slots(whole, CHAIN) == 4 and slots(whole, DYNAMIC_CHAIN) == 8 and slots(mixed, DYNAMIC_CHAIN) == 4
    assert slots(whole, ChainPolicy(balance="dynamic", same_chunk=False, chunk=7)) == 15
    with pytest.raises(ValueError):
        ChainPolicy(balance="odd")


def test_deepening(spark, engine):
    def search(depth, token):
        time.sleep(0.02)
        return depth

    assert engine.deepening(search, limit=3, deadline=Deadline()) == 3
    assert 1 <= engine.deepening(search, limit=10_000, deadline=Deadline.from_millis(500)) < 100
    assert engine.deepening(search, limit=3, deadline=Deadline.from_millis(0)) is None
    reduced = engine.deepening(lambda depth, token: depth * engine.reduce(ones(spark, 50), F.col("v"), 50, init=0.0, token=token), limit=1, deadline=Deadline())
    assert reduced == 50.0


def test_local_operators_have_the_bits_of_the_distributed_ones(spark, engine):
    values = np.random.default_rng(3).normal(0, 1e6, 1000)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "idx long, v double")
    for policy in (Policy(), KAHAN_REDUCE, Policy(chunk=7)):
        assert local.reduce(pa.array(values), init=0.5, determinism=policy.determinism, chunk=policy.chunk) == engine.reduce(df, F.col("v"), 1000, init=0.5, policy=policy)
    assert local.reduce([3, 1, 2], op="min") == 1 and local.reduce([], init=7) == 7
    assert local.scan([1, 2, 3]).tolist() == [1, 3, 6] and local.scan([1, 2, 3], exclusive=True).tolist() == [0, 1, 3]
    add = lambda rows, k: rows.set_column(0, "v", pc.add(rows.column("v"), 1))
    assert local.chain(pa.table({"v": [0, 0, 0, 0]}), [add, add, add], serial=[0], participants=4).column("v").to_pylist() == [3, 2, 2, 2]
    assert local.phases(pa.table({"v": [0]}), 3, add).column("v").to_pylist() == [3]


def test_deadline(spark, engine):
    assert not Deadline().expired and Deadline.from_micros(0).expired and not Deadline.from_millis(60_000).expired
    token = CancellationToken.owned()
    Deadline.from_millis(20).watch(token)
    time.sleep(0.3)
    assert token.stop_requested and Deadline().watch(token) is None


def test_gate_order():
    gate, order = PriorityGate(), []

    def call(priority):
        with gate.admitted(priority):
            order.append(priority)

    with gate.admitted("throughput"):
        threads = []
        for p in ("background", "throughput", "latency"):
            threads.append(threading.Thread(target=call, args=(p,)))
            threads[-1].start()
            while not gate.waiting(p):
                time.sleep(0.01)
    for t in threads:
        t.join()
    assert order == ["latency", "throughput", "background"]


def test_fork_join(spark, engine):
    assert engine.fork_join() == [] and engine.fork_join(lambda: 3) == [3]
    assert engine.fork_join_all(20, lambda i: i * i) == [i * i for i in range(20)]
    nested = engine.fork_join(lambda: engine.fork_join(lambda: 1, lambda: 2), lambda: 3)
    assert nested == [[1, 2], 3]
    counts = engine.fork_join(*[lambda k=k: spark.range(k).count() for k in range(5)])
    assert counts == list(range(5))

    def fails():
        raise KeyError("first")

    with pytest.raises(KeyError, match="first"):
        engine.fork_join(lambda: time.sleep(0.1), fails)


def test_fibonacci_by_forking(spark):
    def fib(e, n):
        return n if n < 2 else sum(e.fork_join(lambda: fib(e, n - 1), lambda: fib(e, n - 2))) if n > 6 else fib(e, n - 1) + fib(e, n - 2)

    assert {fib(Engine(spark, p), 10) for p in (1, 2, 4)} == {55}


def test_detached(spark):
    done, e = [], Engine(spark, 2)
    for k in range(100):
        e.submit_detached(lambda k=k: done.append(k))

    def fails():
        raise ZeroDivisionError

    e.submit_detached(fails)
    e.close()
    assert sorted(done) == list(range(100)) and isinstance(e.last_detached_error, ZeroDivisionError)
    with pytest.raises(RuntimeError):
        e.submit_detached(lambda: None)


def test_detached_from_many_producers(spark):
    done, e = [], Engine(spark, 2)
    producers = [threading.Thread(target=lambda p=p: [e.submit_detached(lambda k=k: done.append((p, k))) for k in range(50)]) for p in range(4)]
    for t in producers:
        t.start()
    for t in producers:
        t.join()
    e.close()
    assert len(set(done)) == 200


def test_async(spark, engine):
    df = ones(spark)
    assert api.sync_wait(engine.reduce_async(df, F.col("v"), 1000)) == 1000.0
    assert api.sync_wait(engine.fork_join_async(lambda: 1, lambda: 2)) == [1, 2]
    order = []
    futures = [engine.submit_detached_async(lambda k=k: order.append(k)) for k in range(5)]
    assert [f.result() for f in futures] == [None] * 5 and order == list(range(5))

    def fails():
        raise OSError("inner")

    with pytest.raises(OSError, match="inner"):
        api.sync_wait(engine.call_async(fails))


def test_group(spark):
    group = EngineGroup(spark, 3)
    shards = [(ones(spark, n), n) for n in (10, 20, 30)]
    assert group.reduce_by_shard(shards, F.col("v"), policy=KAHAN_REDUCE) == ([10.0, 20.0, 30.0], 60.0)
    assert len(group) == 3 and group.shard(1).shard == "shard-1"
    group.close()
