"""What a Python worker holds at a time."""

import gc
import weakref

import numpy as np
import pyarrow as pa

from skysurvey.llm import suffix_dedup as D
from skysurvey.llm.common import prepare


def test_windows_of_spans_come_in_bounded_batches():
    n, rng = 3000, np.random.default_rng(1)
    spans = [rng.integers(97, 123, 199, np.uint8).tobytes() for _ in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([5] * n), pa.array([100] * n, pa.int32()), pa.array(spans, pa.binary())], ["name", "doc", "start", "size", "span"])
    found = list(D.window_batches(iter([batch]), 100))
    assert max(b.num_rows for b in found) <= D.SLICE_WINDOWS and sum(b.num_rows for b in found) == 100 * n
    whole = pa.Table.from_batches(found)
    assert whole["doc"].to_pylist() == [d for d in range(n) for _ in range(100)] and whole["place"].to_pylist() == [5 + k for _ in range(n) for k in range(100)]
    assert whole["window"][3].as_py() == int(D.windows(D.grams(np.frombuffer(spans[0], np.uint8)), np.array([3]), 100).view(np.int64)[0])


def test_batches_are_bounded_by_bytes(spark):
    prepare(spark)
    docs = spark.range(40).repartition(1).selectExpr("repeat('x', 1000000) AS text")
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 40 and max(r.n for r in sizes) <= 10


def test_windows_keeps_no_names_until_garbage_is_collected():
    names = D.grams(np.arange(200, dtype=np.uint8))
    kept = weakref.ref(names)
    gc.disable()
    try:
        D.windows(names, np.arange(3), 100)
        del names
        assert kept() is None
    finally:
        gc.enable()
