"""Python workers outlive their tasks, so what a task has freed must go back to the system."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

_ENCODE = """
import random, re, sys
import pyarrow as pa
from sievelight.llm import nbest

class Docs:
    def selectExpr(self, *columns):
        return self
    def mapInArrow(self, run, schema):
        return run

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

rng = random.Random(7)
texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)) for _ in range(1000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["doc_id", "text"])
before = held()
rows = sum(out.num_rows for out in nbest.encode(Docs())(iter([batch])))
print(rows, round(held() - before))
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_encoding_gives_its_memory_back():
    out = subprocess.run([sys.executable, "-c", _ENCODE], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    rows, kept = map(int, out.stdout.split())
    assert rows == 5000
    assert kept < 60
