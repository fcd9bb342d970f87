"""The corpus pipeline: documents in, packed sequences out, one table after the other.

Each stage works on all that the stage before it kept. What a stage returns is written as Parquet and read
again, so no stage's lineage reaches behind its input, and a lost executor costs one stage's tasks. A table is removed
once the next one has been written.

Cases: rows with a null or empty text fail the quality rules and go. A null id or source is a value like others. Rows alike in id and
text are one document from the join on; ties in it go to the least id, null last, then to the least hash. Columns beside those of documents
stay until packing, whatever their names. An empty table gives no pieces. Very long texts are taken whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hustings.llm import jaccard, mixing, packing, quality, secrets
from hustings.llm.common import ensure_checkpoint_dir

#: Name and function of each stage; a function takes (spark, docs, sf_dir).
STAGES = [
    ("quality_rules", quality.stage),
    ("jaccard_join", jaccard.stage),
    ("secret_scans", secrets.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can't express the flow of the mix, nor the tokens of the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the tables between them go to the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of our own, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
