"""Calls of injected models: several attempts, waiting in between."""

from __future__ import annotations

import time
from collections.abc import Callable


def patient(call: Callable, attempts: int = 3, wait: Callable[[int], float] = lambda n: 2.0**n, retry: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call``, tried again where ``retry`` says so; None after the last attempt."""

    def run(*args, **kwargs):
        for n in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception as e:  # whatever the service raises
                if not retry(e):
                    return None
                if n + 1 < attempts:
                    sleep(wait(n))
        return None

    return run


def in_turn(keys: list[str]) -> Callable[[], str]:
    """Keys one after the other, over and over."""
    at = -1

    def pick() -> str:
        nonlocal at
        at = (at + 1) % len(keys)
        return keys[at]

    return pick
