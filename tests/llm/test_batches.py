import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from careerloom.llm.common import BATCH_BYTES, batches_of, give_back


def test_batches_are_bounded_by_bytes(spark):
    """Texts of 40 kB: ten thousand of them would be one batch of 40 MB in one task."""
    rows = spark.range(1000, numPartitions=1).select("id", F.repeat(F.lit("word "), 8000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    got = batches_of(rows, sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 1000
    assert max(r.bytes for r in got) < 2 * BATCH_BYTES


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def test_freed_memory_goes_back():
    """Small arrays lie in the C library's heap, which it keeps while something above them is in use."""
    held = [np.full(2000, i) for i in range(8000)]  # 128 MB in pieces of 16 kB
    last = held[-1]
    full = _resident()
    del held
    give_back()
    assert full - _resident() > 100 << 20 and last[0] == 7999
