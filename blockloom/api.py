"""The engine's operators as functions: each is the method of the same name."""

from __future__ import annotations

from concurrent.futures import Future
from typing import Any

from blockloom.engine import Engine


def map_blocks(engine: Engine, *args: Any, **options: Any) -> Any:
    return engine.map_blocks(*args, **options)


def reduce(engine: Engine, *args: Any, **options: Any) -> Any:
    return engine.reduce(*args, **options)


def scan(engine: Engine, *args: Any, **options: Any) -> Any:
    return engine.scan(*args, **options)


def inclusive_scan(engine: Engine, *args: Any, **options: Any) -> Any:
    return engine.inclusive_scan(*args, **options)


def chain(engine: Engine, *args: Any, **options: Any) -> Any:
    return engine.chain(*args, **options)


def phases(engine: Engine, *args: Any, **options: Any) -> Any:
    return engine.phases(*args, **options)


def bulk(engine: Engine, *args: Any, **options: Any) -> Any:
    return engine.bulk(*args, **options)


def bulk_nearest(engine: Engine, *args: Any, **options: Any) -> Any:
    return engine.bulk_nearest(*args, **options)


def fork_join(engine: Engine, *args: Any, **options: Any) -> Any:
    return engine.fork_join(*args, **options)


def submit_detached(engine: Engine, *args: Any, **options: Any) -> Any:
    return engine.submit_detached(*args, **options)


def sync_wait(future: Future) -> Any:
    """The future's result; its error is raised here."""
    return future.result()
