"""Policies, cancellation, deadlines and the priority gate."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

PRIORITIES = ("latency", "throughput", "background")


@dataclass(frozen=True)
class Policy:
    """How an operator runs.

    balance sets a map's blocks: one a participant (static) or two (dynamic). determinism picks the reduction's tree:
    fixed or kahan. priority orders callers at the engine's gate and names their scheduler pool. chunk is the block size,
    0 to derive it. An input whose estimated time, n * estimated_item_ns, is under min_task_us for each participant runs
    as one partition. Without cancellation_checks a token is not looked at.
    """

    balance: str = "dynamic"
    determinism: str = "fixed"
    priority: str = "throughput"
    chunk: int = 0
    estimated_item_ns: float = 0.0
    min_task_us: float = 0.0
    cancellation_checks: bool = True

    def __post_init__(self) -> None:
        if self.balance not in ("static", "dynamic") or self.determinism not in ("fixed", "kahan") or self.priority not in PRIORITIES or self.chunk < 0:
            raise ValueError(f"no such policy: {self}")

    def inline(self, n: int, participants: int) -> bool:
        return bool(self.min_task_us) and n * self.estimated_item_ns * 1e-3 < self.min_task_us * participants


@dataclass(frozen=True)
class ChainPolicy:
    """How a chain runs.

    Slots own the same contiguous rows in every stage, unless balance is dynamic, same_chunk is off and every stage ends at
    a barrier of all slots: then a stage's slots are blocks of `chunk` rows (0: half a participant's share), dealt out anew
    before each stage. priority and cancellation_checks as in Policy.
    """

    balance: str = "static"
    same_chunk: bool = True
    priority: str = "throughput"
    chunk: int = 0
    cancellation_checks: bool = True

    def __post_init__(self) -> None:
        if self.balance not in ("static", "dynamic") or self.priority not in PRIORITIES or self.chunk < 0:
            raise ValueError(f"no such policy: {self}")


DEFAULT = Policy()
CHAIN = ChainPolicy()
DYNAMIC_CHAIN = ChainPolicy(balance="dynamic", same_chunk=False)
STATIC = Policy(balance="static")
DYNAMIC = Policy(balance="dynamic")
LATENCY = Policy(priority="latency")
BULK = Policy(priority="background")
KAHAN_REDUCE = Policy(determinism="kahan")
FIXED_REDUCE = Policy(determinism="fixed")


class CancellationToken:
    """A flag shared by its copies. Made without owned() it never stops."""

    def __init__(self) -> None:
        self._event: threading.Event | None = None
        self._lock = threading.Lock()
        self._watchers: list[Callable[[], None]] = []

    @classmethod
    def owned(cls) -> CancellationToken:
        token = cls()
        token._event = threading.Event()
        return token

    @property
    def can_stop(self) -> bool:
        return self._event is not None

    @property
    def stop_requested(self) -> bool:
        return self._event is not None and self._event.is_set()

    def request_stop(self) -> bool:
        """True for the call that stopped it, once. Running jobs that watch the token are cancelled."""
        if self._event is None:
            return False
        with self._lock:
            if self._event.is_set():
                return False
            self._event.set()
            watchers = list(self._watchers)
        for watcher in watchers:
            watcher()
        return True

    @contextmanager
    def watched(self, on_stop: Callable[[], None]) -> Iterator[None]:
        """on_stop is called if the token stops inside the block."""
        with self._lock:
            self._watchers.append(on_stop)
        try:
            yield
        finally:
            with self._lock:
                self._watchers.remove(on_stop)


class Cancelled(Exception):
    """A reduction was stopped; partial_value combines init with the blocks that had completed, in their order."""

    def __init__(self, partial_value: Any) -> None:
        super().__init__("the reduction was stopped")
        self.partial_value = partial_value


class Deadline:
    """A moment of the monotonic clock. It stops nothing by itself; watch() makes it stop a token. Without one it never expires."""

    def __init__(self, at: float | None = None) -> None:
        self.at = at

    @classmethod
    def from_millis(cls, ms: float) -> Deadline:
        return cls(time.monotonic() + ms / 1e3)

    @classmethod
    def from_micros(cls, us: float) -> Deadline:
        return cls(time.monotonic() + us / 1e6)

    @property
    def expired(self) -> bool:
        return self.at is not None and time.monotonic() >= self.at

    def watch(self, token: CancellationToken) -> threading.Timer | None:
        """A timer that stops the token when the deadline expires; cancel() it when it is no longer needed."""
        if self.at is None:
            return None
        timer = threading.Timer(max(0.0, self.at - time.monotonic()), token.request_stop)
        timer.daemon = True
        timer.start()
        return timer


class PriorityGate:
    """One holder at a time; of those that wait, latency goes before throughput, and both before background. No preemption."""

    def __init__(self) -> None:
        self._changed = threading.Condition()
        self._held = False
        self._waiting = dict.fromkeys(PRIORITIES, 0)

    @contextmanager
    def admitted(self, priority: str = "throughput") -> Iterator[None]:
        ahead = PRIORITIES[: PRIORITIES.index(priority)]
        with self._changed:
            self._waiting[priority] += 1
            self._changed.wait_for(lambda: not self._held and not any(self._waiting[p] for p in ahead))
            self._waiting[priority] -= 1
            self._held = True
            self._changed.notify_all()
        try:
            yield
        finally:
            with self._changed:
                self._held = False
                self._changed.notify_all()

    def waiting(self, priority: str) -> int:
        with self._changed:
            return self._waiting[priority]
