"""Shared helpers of the training-data operators.

Edge cases, for every operator: only the named input columns are read (extra or clashing columns are
ignored), a null text counts as empty, repeated rows are separate rows, an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the ASCII white space of the contracts, as a regular expression class body.
WS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the machine keeps a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def texts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text), null text as empty; and the columns named in ``carry``, as _name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *(F.col(c).alias(f"_{c}") for c in carry))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerframe-checkpoint-"))
    return df.checkpoint()


def bytes_of(df: DataFrame) -> int:
    """The optimizer's size estimate: for file scans, the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, target: int, least: int = 1) -> int:
    """How many pieces of about ``target`` bytes hold ``df``. An unknown size counts as a few pieces a task."""
    size = bytes_of(df)
    if size >= 1 << 60:
        return max(least, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-size // target))
