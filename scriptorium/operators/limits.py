"""Calls to a remote service from many tasks: classes of errors, and one rate for the whole cluster."""

from __future__ import annotations

import contextlib
import os
import random
import time
from collections.abc import Callable
from dataclasses import dataclass


class RateLimited(Exception):
    """The service asks for fewer calls: the next attempt waits twice as long as the last one."""


class ServiceError(Exception):
    """The service failed: the next attempt waits a fixed time."""


@dataclass(frozen=True)
class Outcome:
    """A call's answer, or the class and text of its last error, and how many attempts it took."""

    raw: str
    error: str | None
    kind: str | None
    attempts: int


def called(call: Callable[[], str], attempts: int = 3, pause: float = 5.0, before: Callable[[], None] = lambda: None, limited: Callable[[float], None] = lambda s: None, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """Try a call: after RateLimited the pause is pause, twice that, four times that and so on, after ServiceError always `pause`; any other error ends it.

    `before` runs before each attempt, and `limited` is told of each pause that the service asked for.
    """
    why, k = ServiceError("no attempt"), 0
    for k in range(1, attempts + 1):
        before()
        try:
            return Outcome(call(), None, None, k)
        except RateLimited as e:
            why, wait = e, pause * 2 ** (k - 1)
            limited(wait)
        except ServiceError as e:
            why, wait = e, pause
        except Exception as e:  # noqa: BLE001  clients have errors of their own, which another attempt would not mend
            return Outcome("", f"{type(e).__name__}: {e}", "other", k)
        if k < attempts:
            sleep(wait)
    return Outcome("", f"{type(why).__name__}: {why}", "rate" if isinstance(why, RateLimited) else "service", k)


class SharedRate:
    """At most `per_second` calls a second by all tasks that share a folder, and no call while any of them was told to pause.

    A call needs a lease: a file of the running second with one of per_second numbers, which can be made only once. The folder must be one that all
    machines mount, with one clock within a second; leases of seconds past are removed by whoever finds them. A task that ends without its
    calls leaves nothing to be given back.
    """

    def __init__(self, folder: str, per_second: int, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
        if per_second < 1:
            raise ValueError("at least one call a second")
        self.folder, self.per_second, self.clock, self.sleep = folder.removeprefix("file://"), per_second, clock, sleep
        self.cleaned = 0
        os.makedirs(self.folder, exist_ok=True)

    def _make(self, name: str) -> bool:
        try:
            os.close(os.open(os.path.join(self.folder, name), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True

    def _paused_until(self) -> float:
        return max((float(n.removeprefix("pause-")) for n in os.listdir(self.folder) if n.startswith("pause-")), default=0.0)

    def pause(self, seconds: float) -> None:
        """Nobody calls for so long."""
        self._make(f"pause-{self.clock() + seconds:.3f}")

    def lease(self) -> None:
        """Wait until a call is allowed."""
        while True:
            now = self.clock()
            if (until := self._paused_until()) > now:
                self.sleep(until - now)
                continue
            second = int(now)
            self._clean(second)
            numbers = list(range(self.per_second))
            random.shuffle(numbers)  # many tasks begin at different numbers
            if any(self._make(f"lease-{second}-{k}") for k in numbers):
                return
            self.sleep(max(0.01, second + 1 - self.clock()))

    def _clean(self, second: int) -> None:
        if second - self.cleaned < 10:
            return
        self.cleaned = second
        for n in os.listdir(self.folder):
            at = n.split("-")[1] if n.startswith(("lease-", "pause-")) else None
            if at and float(at) < second - 5:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(os.path.join(self.folder, n))
