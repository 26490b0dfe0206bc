"""What a Python worker holds between tasks."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]

IDLE = """
import re, sys
import numpy as np, pyarrow as pa
from pathlib import Path
from pyspark.sql import types as T
from tidebook.llm import quality, simhash, text

held = lambda: sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

class Frame:  # gives back the function that a stage's workers run
    schema = T.StructType([T.StructField("text", T.StringType())])
    drop = lambda self, *names: self
    mapInArrow = lambda self, run, schema: run

words = np.array([f"word{k}" for k in range(5000)])
batch = lambda k: pa.RecordBatch.from_pydict({"text": [" ".join(np.random.default_rng(k * 1000 + i).choice(words, 400)) for i in range(3000)]})
model = quality.Quadratic((0.5, 0.5), np.zeros((2, 12)), np.array([np.eye(12)] * 2), np.zeros(2))
before = held()
for _ in quality.scored(Frame(), model)(map(batch, range(3))):
    pass
def signed(batches):
    for b in batches:
        for piece in text.pieces([b], "text", simhash.PIECE):
            sequence, bits, keys = simhash.signatures(piece.column(0))
            n = len(piece)
            yield pa.RecordBatch.from_pydict({"anchor": np.arange(n), "part": np.zeros(n, np.int64), "id": np.arange(n), "chunk": np.zeros(n, np.int32), "bits": simhash.eights(bits)})
for _ in simhash.by_group(lambda rows: rows)(signed(map(batch, range(3)))):
    pass
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_a_worker_that_waits_keeps_little_memory():
    grown = float(subprocess.run([sys.executable, "-c", IDLE], capture_output=True, text=True, check=True, cwd=ROOT).stdout)
    assert grown < 80  # MB
