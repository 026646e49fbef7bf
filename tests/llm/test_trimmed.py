"""A reused Python worker gives back what its tasks held."""

import re
from pathlib import Path

import numpy as np

from vitrine.llm.common import trimmed


def _mb():
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_memory_goes_back():
    def run(batches):
        for b in batches:
            held = [np.ones(8000, np.uint8) for _ in range(20_000)]  # 160 MB in pieces that malloc keeps
            yield b
            b = held[-1]
        last.append(held.pop())  # at the heap's end, so that nothing above it can be given back by itself

    last: list = []
    before = _mb()
    assert list(trimmed(run)([1])) == [1]
    assert _mb() - before < 40
