"""What Python workers hold: batches bounded in bytes, and memory given back."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tessera.llm.common import tidied

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: MB that a process gains at most in the call, and of its own keeps after it.
BUCKET = """
import gc, json, re
import numpy as np, pyarrow as pa
from tessera.llm import jaccard_join
from tessera.llm.common import binary

def now():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def peak():
    return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def rss():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def bucket(n):
    tokens = np.random.default_rng(0).integers(0, n // 2, n, dtype=np.uint64)
    cls, size = np.arange(n // 5), np.full(n // 5, 5, np.uint32)
    raw = np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :7].reshape(-1)
    return pa.table({"bucket": pa.array([0], pa.int32()), "classes": binary(cls.view(np.uint8), np.array([8 * len(cls)])), "sizes": binary(size.view(np.uint8), np.array([4 * len(cls)])), "tokens": binary(raw, np.array([7 * n]))})

jaccard_join._shared(bucket(100))
gc.collect()
before, table = now(), bucket(jaccard_join.BUCKET)
open("/proc/self/clear_refs", "w").write("5")
held = rss()
out = jaccard_join._shared(table)
most = peak() - held
del out, table
gc.collect()
print(json.dumps({"most": most, "kept": now() - before}))
"""


def test_a_bucket_gives_its_memory_back():
    done = subprocess.run([sys.executable, "-c", BUCKET], capture_output=True, text=True, check=True)
    got = json.loads(done.stdout)
    assert got["most"] < 110 and got["kept"] < 30, got


def test_tidied_yields_all_batches():
    assert list(tidied(lambda batches: (b + 1 for b in batches))(iter([1, 2, 3]))) == [2, 3, 4]


@pytest.mark.parametrize("stage, module, name", [("keep_known_languages", "language", "keep_known"), ("drop_near_copies", "jaccard_join", "drop_near_copies"), ("pack", "packing", "pack_documents")])
def test_stages_send_batches_bounded_in_bytes(spark, monkeypatch, stage, module, name):
    import corpus_pipeline

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "size"])

    monkeypatch.setattr(getattr(corpus_pipeline, module), name, lambda docs, *_: docs.mapInArrow(sizes, "rows long, size long"))
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    spark.conf.unset(KEY)
    try:
        got = getattr(corpus_pipeline, stage)(spark, docs, "").collect()
    finally:
        spark.conf.unset(KEY)
    assert sum(r["rows"] for r in got) == 3000
    assert max(r["size"] for r in got) < 5 << 20
