"""Stages in order, with a barrier after each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.control import CHAIN, ChainPolicy
from blockloom.operators.blocks import block_of, slot_of
from blockloom.storage import materialize


class Barrier(Enum):
    """What holds between a stage and the next."""

    NONE = "none"  #: the next stage sees the rows of its own slot; both run as one
    GLOBAL = "global"  #: every slot has ended
    REDUCE = "reduce"  #: the same; the next stage may use a reduction over all slots
    SERIAL = "serial"  #: the next stage, and only that, runs on slot 0 alone


@dataclass(frozen=True)
class Stage:
    """fn takes (rows of the active slots, stage number) and returns rows of the same columns."""

    name: str
    fn: Callable[[DataFrame, int], DataFrame]
    barrier: Barrier = Barrier.NONE


def static_stage(name: str, fn: Callable[[DataFrame, int], DataFrame]) -> Stage:
    return Stage(name, fn, Barrier.NONE)


def global_stage(name: str, fn: Callable[[DataFrame, int], DataFrame]) -> Stage:
    return Stage(name, fn, Barrier.GLOBAL)


def reduce_stage(name: str, fn: Callable[[DataFrame, int], DataFrame]) -> Stage:
    return Stage(name, fn, Barrier.REDUCE)


def serial_stage(name: str, fn: Callable[[DataFrame, int], DataFrame]) -> Stage:
    return Stage(name, fn, Barrier.SERIAL)


def make_stage(barrier: Barrier, fn: Callable[[DataFrame, int], DataFrame], name: str = "") -> Stage:
    return Stage(name, fn, barrier)


def run_chain(indexed: DataFrame, n: int, stages: list[Stage], *, participants: int, policy: ChainPolicy = CHAIN, token=None, keep: Callable[[DataFrame], None] | None = None, idx: str = "idx") -> DataFrame:
    """indexed (with its slot) after all stages; an empty frame passes through them too.

    Stages without a barrier are one lazy plan, so Spark fuses them. GLOBAL and REDUCE write the rows to the shared
    folder. After SERIAL, the next stage gets slot 0's rows, [0, n / participants), and the others pass by it. A stopped
    token ends the chain before the next stage; what has been done stays. keep: gets the rows after each stage, which is
    then written. See ChainPolicy for what a slot is.
    """
    sc = indexed.sparkSession.sparkContext
    whole = all(s.barrier in (Barrier.GLOBAL, Barrier.REDUCE) for s in stages)
    dealt = policy.balance == "dynamic" and not policy.same_chunk and whole and bool(stages)
    slot = block_of(F.col(idx), policy.chunk or max(1, -(-n // (2 * participants)))).cast("int") if dealt else slot_of(F.col(idx), n, participants)
    rows = indexed.withColumn("slot", slot)
    columns, before = rows.columns, Barrier.NONE
    stops = token is not None and policy.cancellation_checks
    for k, stage in enumerate(stages):
        if stops and token.stop_requested:
            break
        sc.setJobDescription(stage.name or f"stage {k}")
        if dealt:
            rows = rows.repartition("slot")
        if before is Barrier.SERIAL:
            rows = stage.fn(rows.where("slot = 0"), k).select(columns).unionByName(rows.where("slot <> 0"))
        else:
            rows = stage.fn(rows, k).select(columns)
        before = stage.barrier
        if keep is not None or (before in (Barrier.GLOBAL, Barrier.REDUCE) and k + 1 < len(stages)):
            rows = materialize(rows, "stage")
            if keep is not None:
                keep(rows)
    sc.setJobDescription(None)
    return rows


def run_phases(
    rows: DataFrame, n_phases: int, phase: Callable[[DataFrame, int, object], DataFrame], *, pre_phase: Callable[[int], object] | None = None, token=None, cut_every: int = 8, keep: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """rows after n_phases of phase(rows, number, what pre_phase(number) gave).

    pre_phase runs on the driver, once before each phase. Rows keep their columns, so keys keep their slots. The lineage
    is cut by a written table every cut_every phases, which keep is told of. No phases give rows as they are; a stopped
    token ends the loop.
    """
    columns = rows.columns
    for p in range(n_phases):
        if token is not None and token.stop_requested:
            break
        rows = phase(rows, p, pre_phase(p) if pre_phase else None).select(columns)
        if (p + 1) % cut_every == 0:
            rows = materialize(rows, "phase")
            if keep is not None:
                keep(rows)
    return rows
