"""The lexical index behind the retrieval plans: built once, read by all.

Postings, lengths and totals of the documents are written once a session and
input folder to the folder that driver and executors share, and every plan that
names them reads them from there instead of tokenising the corpus anew.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from tessera.plans.dialect import SPARK
from tessera.sources import readers

#: Parts of the index, as tables of a plan (tessera_ix...).
PARTS = ("ixpostings", "ixlengths", "ixtotals")
_built: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of this
    machine, which only a local master can share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def build(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the index of sf_dir's documents; built where it is missing."""
    from tessera.operators.retrieval import index_sql

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        readers.spread(spark, f"{sf_dir}/documents.parquet").createOrReplaceTempView("tessera_documents")
        fields, postings, lengths, totals = index_sql(SPARK)
        terms = spark.sql(f"WITH {fields} {postings}")
        # Laid out by term: the terms of a prefix lie in a few row groups.
        terms.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.parquet(f"{folder}/ixpostings")
        spark.sql(f"WITH {fields} {lengths}").write.parquet(f"{folder}/ixlengths")
        spark.read.parquet(f"{folder}/ixlengths").createOrReplaceTempView("tessera_lengths_")
        spark.sql(totals.replace("lengths", "tessera_lengths_")).write.parquet(f"{folder}/ixtotals")
        _built[key] = folder
        atexit.register(_remove, spark, folder)
    return _built[key]
