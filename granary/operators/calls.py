"""Requests to a model server from a worker: several in flight at once, in order, tried again."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

#: Requests that a worker has under way at once, unless said otherwise.
WINDOW = 8


def ordered(ask: Callable[[Any], Any], items: Iterable[Any], window: int = WINDOW) -> Iterator[Any]:
    """ask(item) of each item, in their order; never more than `window` are under way or waiting to be taken."""
    with ThreadPoolExecutor(max(1, window)) as pool:
        waiting: deque = deque()
        for item in items:
            if len(waiting) >= max(1, window):
                yield waiting.popleft().result()
            waiting.append(pool.submit(ask, item))
        while waiting:
            yield waiting.popleft().result()


def retried(ask: Callable[..., Any], tries: int = 3, wait: float = 0.5, errors: tuple[type[BaseException], ...] = (OSError,)) -> Callable[..., Any]:
    """ask, called up to `tries` times while it fails with one of the errors, with waits of wait, 2 * wait, ...; the last failure goes through."""

    def again(*args: Any) -> Any:
        for turn in range(tries):
            try:
                return ask(*args)
            except errors:
                if turn == tries - 1:
                    raise
                time.sleep(wait * 2**turn)

    return again
