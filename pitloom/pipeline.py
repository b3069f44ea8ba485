"""A sequence of stages with retries, as a daily or a full run is made of."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Stage:
    name: str
    status: str  # done, failed or skipped
    tries: int
    seconds: float = 0.0
    error: str = ""


def run(stages: dict[str, Callable[[], object]], waits: tuple[float, ...] = (10, 60, 300), keep_going: bool = False) -> list[Stage]:
    """Runs the stages in order, each tried again after every wait; after a failure the rest is skipped, unless ``keep_going``."""
    out: list[Stage] = []
    for name, step in stages.items():
        if not keep_going and any(s.status == "failed" for s in out):
            out.append(Stage(name, "skipped", 0))
            continue
        began = time.monotonic()
        for tries, wait in enumerate((*waits, None), 1):
            try:
                step()
            except Exception as e:  # noqa: BLE001 - reported with the stage
                error = str(e)
                if wait is not None:
                    time.sleep(wait)
                    continue
                out.append(Stage(name, "failed", tries, time.monotonic() - began, error[:500]))
            else:
                out.append(Stage(name, "done", tries, time.monotonic() - began))
            break
    return out
