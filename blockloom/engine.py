"""The engine: every ordered operator behind one object, with policies, cancellation, priorities and background work."""

from __future__ import annotations

import base64
import functools
import math
import pickle
import re
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager, nullcontext
from typing import Any

import pyarrow as pa
from pyspark import InheritableThread, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.control import CHAIN, DEFAULT, CancellationToken, Cancelled, ChainPolicy, Deadline, Policy, PriorityGate
from blockloom.operators import bulk, reduce, scan
from blockloom.operators.blocks import block_of, chunk_size, reduce_chunk, with_index
from blockloom.plans import chain
from blockloom.storage import materialize

_NEVER = CancellationToken()
#: Rows that one call of a map's function gets at most, unless the policy names a chunk.
CALL_ROWS = 1 << 20
_RAISED = re.compile(r"<blockloom-error ([A-Za-z0-9+/=]+)>")


def _carried(body: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """body, whose errors carry themselves in their message, as Spark passes on text alone."""

    def run(rows: pa.Table) -> pa.Table:
        try:
            return body(rows)
        except Exception as e:
            raise RuntimeError(f"{type(e).__name__}: {e} <blockloom-error {base64.b64encode(cloudpickle.dumps(e)).decode()}>") from e

    return run


def _cause(error: BaseException) -> BaseException:
    """The error that a map's function raised, or Spark's where there is none."""
    found = _RAISED.search(str(error))
    return pickle.loads(base64.b64decode(found[1])) if found else error


class Engine:
    """Runs ordered operators on frames that have a dense 0-based idx (with_index makes one).

    participants: slots of chains and the measure of map blocks; by default Spark's parallelism. What the engine runs goes
    through its gate one call at a time, by priority, in a job group of its own. A frame is lazy, for the caller to run,
    unless it is asked for with a token that can stop or by an asynchronous call: then its rows are computed before the
    call ends, written to the shared folder, and the token cancels the running job. The first error of such a call is
    raised, that of a map's function as itself; the rest of the call is dropped. Closing waits for detached work. Copies
    of an engine share nothing.
    """

    def __init__(self, spark: SparkSession, participants: int | None = None, shard: str | None = None) -> None:
        if participants is not None and participants < 1:
            raise ValueError("an engine needs a participant")
        self.spark, self.participants, self.shard = spark, participants or spark.sparkContext.defaultParallelism, shard
        self._gate, self._lock, self._inside = PriorityGate(), threading.Lock(), threading.local()
        self._detached: set[threading.Thread] = set()
        self._pool: ThreadPoolExecutor | None = None
        self._error: BaseException | None = None
        self._closed = False
        self._counters = {"dispatches": 0, "inline_fallbacks": 0, "cancellation_stops": 0}

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Wait for all detached and asynchronous work; nothing can be submitted afterwards."""
        with self._lock:
            self._closed = True
        while threads := list(self._detached):
            for t in threads:
                t.join()
        if self._pool:
            self._pool.shutdown(wait=True)

    def counters(self) -> dict[str, int]:
        with self._lock:
            return dict(self._counters)

    def _count(self, name: str) -> None:
        with self._lock:
            self._counters[name] += 1

    @contextmanager
    def _admitted(self, policy: Policy, token: CancellationToken) -> Iterator[str]:
        """The gate, the scheduler pool, and a job group that the token cancels. A nested call runs under the outer one's."""
        sc, group = self.spark.sparkContext, f"blockloom-{uuid.uuid4().hex}"
        nested = getattr(self._inside, "on", False)
        watch = token.watched(lambda: sc.cancelJobGroup(group)) if token.can_stop and policy.cancellation_checks else nullcontext()
        with nullcontext() if nested else self._gate.admitted(policy.priority), watch:
            self._count("dispatches")
            if not nested:
                sc.setLocalProperty("spark.scheduler.pool", self.shard or policy.priority)
                sc.setJobGroup(group, f"{policy.priority} call", interruptOnCancel=True)
            self._inside.on = True
            try:
                yield group
            finally:
                self._inside.on = nested
                if not nested:
                    sc.setLocalProperty("spark.jobGroup.id", None)
                    sc.setLocalProperty("spark.scheduler.pool", None)

    def _stopped(self, policy: Policy, token: CancellationToken) -> bool:
        if policy.cancellation_checks and token.stop_requested:
            self._count("cancellation_stops")
            return True
        return False

    def index(self, df: DataFrame, *keys: Column | str, name: str = "idx") -> DataFrame:
        return with_index(df, *keys, name=name)

    def _run(self, plan: Callable[[], DataFrame], stopped: Callable[[], DataFrame], policy: Policy | ChainPolicy, token: CancellationToken, now: bool, name: str) -> DataFrame:
        """plan() as it is, or if `now`, or if the token can stop, its rows computed under the gate; what stopped() gives if the token stops."""
        if self._stopped(policy, token):
            return stopped()
        if not now and not (token.can_stop and policy.cancellation_checks):
            return plan()
        with self._admitted(policy, token):
            if self._stopped(policy, token):
                return stopped()
            try:
                return materialize(plan(), name)
            except Exception as e:
                if policy.cancellation_checks and token.stop_requested:
                    self._count("cancellation_stops")
                    return stopped()
                if (cause := _cause(e)) is not e:
                    raise cause from e
                raise

    def map_blocks(self, indexed: DataFrame, n: int, body: Callable[[pa.Table], pa.Table] | Column | list[Column], schema: str | None = None, *, policy: Policy = DEFAULT, token: CancellationToken = _NEVER, now: bool = False, waves: int = 8) -> DataFrame:
        """body of each block of rows, every row once. Column expressions stay one narrow stage; a function gets whole blocks, of CALL_ROWS rows at most.

        With a token that can stop, blocks run in waves; if it stops, the rows of completed waves are what there is. An
        empty frame gives none.
        """
        size = chunk_size(n, self.participants, policy.chunk, policy.balance)
        size = size if policy.chunk else min(size, CALL_ROWS)
        inline = not isinstance(body, (Column, list)) and policy.inline(n, self.participants)
        if inline:
            self._count("inline_fallbacks")

        def mapped(rows: DataFrame) -> DataFrame:
            if isinstance(body, (Column, list)):
                return rows.select(*(body if isinstance(body, list) else [body]))
            call = _carried(body)
            blocks = (rows.coalesce(1) if inline else rows).withColumn("__block", block_of(F.col("idx"), size))
            return blocks.groupBy("__block").applyInArrow(lambda t: call(t.sort_by("idx").drop_columns(["__block"])), schema)

        none = lambda: mapped(indexed.limit(0))
        if not (token.can_stop and policy.cancellation_checks):
            return self._run(lambda: mapped(indexed), none, policy, token, now, "map")
        step, done = -(-max(1, -(-n // size)) // waves) * size, []
        for lo in range(0, max(n, 1), step):
            part = indexed.where((F.col("idx") >= lo) & (F.col("idx") < lo + step))
            out = self._run(lambda part=part: mapped(part), lambda: None, policy, token, True, "map")
            if out is None:
                break
            done.append(out)
        return functools.reduce(DataFrame.unionByName, done) if done else none()

    def reduce(self, indexed: DataFrame, value: Column, n: int, *, op: str = "sum", init: Any = None, policy: Policy = DEFAULT, token: CancellationToken = _NEVER, waves: int = 8) -> Any:
        """The ordered reduction as a value; see reduce_blocks. An empty frame gives init.

        With a token that can stop, blocks run in waves; if it stops, Cancelled carries the completed blocks' value, or
        init if there is none.
        """
        start = None if init is None else F.lit(init)
        with self._admitted(policy, token):
            if n == 0:
                return init
            if not (token.can_stop and policy.cancellation_checks):
                return reduce.reduce_blocks(indexed, value, n, op=op, init=start, determinism=policy.determinism, chunk=policy.chunk).first()[0]
            size = reduce_chunk(n, policy.chunk)
            n_blocks = -(-n // size)
            step, done = -(-n_blocks // waves), []
            for lo in range(0, n_blocks, step):
                if token.stop_requested:
                    break
                part = indexed.where((F.col("idx") >= lo * size) & (F.col("idx") < (lo + step) * size))
                try:
                    done.append(materialize(reduce.block_partials(part, value, size, op), "partials"))
                except Exception:
                    if not token.stop_requested:
                        raise
                    break
            stopped = token.stop_requested
            found = init
            if done:
                # Blocks left out by the stop move together, so the tree is over the completed ones in their order.
                partials = functools.reduce(DataFrame.unionByName, done)
                found = reduce.combined(partials, min(n_blocks, len(done) * step), op=op, init=start, determinism=policy.determinism).first()[0]
            if stopped:
                self._count("cancellation_stops")
                raise Cancelled(found)
            return found

    def scan(self, indexed: DataFrame, value: Column, n: int, *, op: str = "sum", exclusive: bool = False, identity: Any = None, policy: Policy = DEFAULT, token: CancellationToken = _NEVER, now: bool = False, name: str = "scan") -> DataFrame:
        """indexed with the running value; see scan_blocks. A stopped token gives the identity on every row."""
        start = None if identity is None else F.lit(identity)
        plan = lambda: scan.scan_blocks(indexed, value, n, op=op, exclusive=exclusive, identity=start, chunk=policy.chunk, name=name)
        return self._run(plan, lambda: indexed.withColumn(name, start if start is not None else F.lit(None)), policy, token, now, "scan")

    def inclusive_scan(self, indexed: DataFrame, value: Column, n: int, **options: Any) -> DataFrame:
        return self.scan(indexed, value, n, exclusive=False, **options)

    def chain(self, indexed: DataFrame, n: int, stages: list[chain.Stage], *, policy: ChainPolicy = CHAIN, token: CancellationToken = _NEVER, now: bool = False) -> DataFrame:
        """See run_chain. A stopped chain ends with the rows of its last completed stage."""
        kept: list[DataFrame] = []
        keep = kept.append if token.can_stop and policy.cancellation_checks else None
        plan = lambda: chain.run_chain(indexed, n, stages, participants=self.participants, policy=policy, token=token, keep=keep)
        return self._run(plan, lambda: kept[-1] if kept else chain.run_chain(indexed, n, [], participants=self.participants, policy=policy), policy, token, now, "chain")

    def phases(self, rows: DataFrame, n_phases: int, phase: Callable[[DataFrame, int, object], DataFrame], *, pre_phase: Callable[[int], object] | None = None, policy: Policy = DEFAULT, token: CancellationToken = _NEVER, now: bool = False) -> DataFrame:
        """See run_phases. A stopped run ends with the rows of the last phase after which they were written."""
        kept = [rows]
        plan = lambda: chain.run_phases(rows, n_phases, phase, pre_phase=pre_phase, token=token, keep=kept.append)
        return self._run(plan, lambda: kept[-1], policy, token, now, "phases")

    def bulk(self, queries: DataFrame, n: int, body: Callable[[pa.Table], pa.Table] | Column | list[Column], schema: str | None = None, **options: Any) -> DataFrame:
        """Independent queries with a dense idx, in blocks; body keeps each result with its query."""
        return self.map_blocks(queries, n, body, schema, **options)

    def bulk_nearest(self, queries: DataFrame, refs: DataFrame, *, policy: Policy = DEFAULT, token: CancellationToken = _NEVER, now: bool = False, **options: Any) -> DataFrame:
        none = lambda: self.spark.createDataFrame([], "query_id long, nearest_id long, distance2 double")
        return self._run(lambda: bulk.nearest(queries, refs, **options), none, policy, token, now, "nearest")

    def deepening(self, search: Callable[[int, CancellationToken], Any], *, limit: int, deadline: Deadline, token: CancellationToken | None = None) -> Any:
        """What search(depth, token) gives at the last depth, from 1 to limit, that was completed before the deadline; None without any.

        The deadline stops the token, and with it the engine's calls that search makes with it.
        """
        token, best = token or CancellationToken.owned(), None
        timer = deadline.watch(token)
        try:
            for depth in range(1, limit + 1):
                if token.stop_requested:
                    break
                try:
                    found = search(depth, token)
                except Cancelled:
                    break
                if not token.stop_requested:
                    best = found
        finally:
            if timer:
                timer.cancel()
        return best

    def fork_join(self, *fns: Callable[[], Any], policy: Policy = DEFAULT, token: CancellationToken = _NEVER) -> list[Any]:
        """The results of independent driver functions, run side by side and joined; one runs where it is, none is no call.

        Functions not begun when the token stops, or after another has failed, are skipped and give None; then the first
        error is raised. Calls may nest.
        """
        if not fns:
            return []
        if len(fns) == 1:
            self._count("inline_fallbacks")
            return [None if self._stopped(policy, token) else fns[0]()]
        out, errors = [None] * len(fns), []
        take, lock = iter(range(len(fns))), threading.Lock()

        def work() -> None:
            while True:
                with lock:
                    k = next(take, None)
                if k is None or errors or self._stopped(policy, token):
                    return
                try:
                    out[k] = fns[k]()
                except BaseException as e:  # noqa: BLE001  raised at the join
                    errors.append(e)

        sc, pool = self.spark.sparkContext, "spark.scheduler.pool"
        outer = sc.getLocalProperty(pool)
        sc.setLocalProperty(pool, self.shard or policy.priority)  # the threads' own jobs run in it
        try:
            threads = [InheritableThread(target=work) for _ in range(min(len(fns), self.participants))]
            for t in threads:
                t.start()
        finally:
            sc.setLocalProperty(pool, outer)
        for t in threads:
            t.join()
        if errors:
            raise errors[0]
        return out

    def fork_join_all(self, n: int, body: Callable[[int], Any], **options: Any) -> list[Any]:
        return self.fork_join(*[lambda k=k: body(k) for k in range(n)], **options)

    def submit_detached(self, fn: Callable[[], Any], *, token: CancellationToken = _NEVER) -> None:
        """Run fn in the background. close() waits for it; the first error is kept in last_detached_error."""

        def run() -> None:
            try:
                if not token.stop_requested:
                    fn()
            except BaseException as e:  # noqa: BLE001  kept for the caller
                with self._lock:
                    self._error = self._error or e
            finally:
                self._detached.discard(thread)

        thread = InheritableThread(target=run)
        with self._lock:
            if self._closed:
                raise RuntimeError("the engine is closed")
            self._detached.add(thread)
        thread.start()

    @property
    def last_detached_error(self) -> BaseException | None:
        return self._error

    def call_async(self, fn: Callable[..., Any], *args: Any, **options: Any) -> Future:
        """A future of fn(*args); asynchronous calls of one engine run in the order they were made. Those of operators end with their rows written."""
        with self._lock:
            if self._closed:
                raise RuntimeError("the engine is closed")
            self._pool = self._pool or ThreadPoolExecutor(1, thread_name_prefix="blockloom")
            return self._pool.submit(fn, *args, **options)

    def reduce_async(self, *args: Any, **options: Any) -> Future:
        return self.call_async(self.reduce, *args, **options)

    def scan_async(self, *args: Any, **options: Any) -> Future:
        return self.call_async(self.scan, *args, now=True, **options)

    def map_blocks_async(self, *args: Any, **options: Any) -> Future:
        return self.call_async(self.map_blocks, *args, now=True, **options)

    def chain_async(self, *args: Any, **options: Any) -> Future:
        return self.call_async(self.chain, *args, now=True, **options)

    def phases_async(self, *args: Any, **options: Any) -> Future:
        return self.call_async(self.phases, *args, now=True, **options)

    def bulk_async(self, *args: Any, **options: Any) -> Future:
        return self.call_async(self.bulk, *args, now=True, **options)

    def bulk_nearest_async(self, *args: Any, **options: Any) -> Future:
        return self.call_async(self.bulk_nearest, *args, now=True, **options)

    def fork_join_async(self, *fns: Callable[[], Any], **options: Any) -> Future:
        return self.call_async(self.fork_join, *fns, **options)

    def submit_detached_async(self, fn: Callable[[], Any]) -> Future:
        """Unlike submit_detached(), a future that ends with fn."""
        return self.call_async(fn)


class EngineGroup:
    """Engines for the shards of a table, each with its own gate and scheduler pool, and one over all."""

    def __init__(self, spark: SparkSession, shards: int) -> None:
        if shards < 1:
            raise ValueError("a group needs a shard")
        own = max(1, math.ceil(spark.sparkContext.defaultParallelism / shards))
        self.all = Engine(spark)
        self.engines = [Engine(spark, own, f"shard-{k}") for k in range(shards)]

    def __len__(self) -> int:
        return len(self.engines)

    def shard(self, k: int) -> Engine:
        return self.engines[k]

    def reduce_by_shard(self, indexed_shards: list[tuple[DataFrame, int]], value: Column, *, init: Any = 0.0, policy: Policy = DEFAULT) -> tuple[list[Any], Any]:
        """(each shard's reduction, all of them added from the left in shard order); shards run side by side."""
        calls = [lambda e=e, s=s: e.reduce(s[0], value, s[1], init=init, policy=policy) for e, s in zip(self.engines, indexed_shards, strict=True)]
        partials = self.all.fork_join(*calls)
        total = init
        for p in partials:
            total = total + p
        return partials, total

    def close(self) -> None:
        for e in [self.all, *self.engines]:
            e.close()
