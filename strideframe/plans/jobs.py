"""Several Spark jobs at once from one driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

A = TypeVar("A")
B = TypeVar("B")


def side_by_side(work: Callable[[A], B], items: Iterable[A], workers: int = 4) -> list[B]:
    """Results in input order; at most `workers` jobs are submitted at a time.

    Model fits are sequences of short jobs, which leave executors idle when run one after the other.
    """
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        return list(pool.map(work, items))
