"""One tick: predictions are logged, with retries, then matured ones are graded and the weights fitted."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable
from typing import Any

log = logging.getLogger(__name__)
#: Attempts, and seconds of waiting per attempt so far.
ATTEMPTS, WAIT = 3, 3.0


def attempt(work: Callable[[], Any], attempts: int = ATTEMPTS, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Whether ``work`` came through in one of the attempts; the waits between them grow by ``wait``."""
    for k in range(1, attempts + 1):
        try:
            work()
            return True
        except Exception as e:  # one group's data must not stop the others
            log.warning("attempt %d of %d failed: %s", k, attempts, e)
            if k < attempts:
                sleep(wait * k)
    return False


def tick(groups: Iterable[Any], snapshot: Callable[[Any], Any], learn: Callable[[], Any], **retry) -> tuple[int, Any]:
    """Snapshots each group of tickers (a DataFrame job each, not one per ticker), then learns.

    Returns how many groups were logged and what ``learn`` returned; fails if none was, after learning.
    """
    done = sum(attempt(lambda g=g: snapshot(g), **retry) for g in groups)
    learned = learn()
    if not done:
        raise RuntimeError("no group could be logged")
    return done, learned


def run_ticks(ticks: Callable[[], Any], every: float, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Calls ``ticks`` every so many seconds; a failed one is logged and the next goes on.  Returns how many failed."""
    failed, n = 0, 0
    while rounds is None or n < rounds:
        if n:
            sleep(every)
        n += 1
        try:
            ticks()
        except Exception as e:
            failed += 1
            log.error("tick %d failed: %s", n, e)
    return failed
