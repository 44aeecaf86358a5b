from pathlib import Path

import numpy as np

from burnish.llm.common import trimmed

_KEPT = []


def _resident_mb():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


def _work(batches):
    """Takes 200 MB in blocks that the C library does not map one by one, and keeps the last, behind which nothing is free."""
    blocks = [np.ones(64 << 10, np.uint8) for _ in range(3200)]
    _KEPT.append(blocks[-1])
    yield from batches
    del blocks


def test_memory_of_a_finished_task_is_given_back():
    list(_work([]))
    before = _resident_mb()
    assert list(trimmed(_work)([1, 2])) == [1, 2]
    assert _resident_mb() < before - 100
