"""What the text operators share: reading, words, shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids fall in no held-out bucket."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n), F.lit(-1))


def free_name(frame: DataFrame, wish: str) -> str:
    """A column name that the frame doesn't use yet (Spark compares names without case)."""
    taken = {c.lower() for c in frame.columns}
    while wish.lower() in taken:
        wish = f"{wish}_"
    return wish


def settled(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """withColumns whose values are computed once for each row.

    Catalyst merges neighbouring projections, and a column that a lambda names would then be
    computed again for every element. A generator of one row stands between the two.
    """
    held = free_name(frame, "_held")
    out = frame.withColumn(held, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    keep = [F.col(f"`{c}`") for c in frame.columns if c not in columns]
    return out.select(*keep, *[F.col(f"{held}.{n}").alias(n) for n in columns])


@lru_cache(maxsize=1)
def _local_folder(master: str) -> str:
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


class Scratch:
    """Tables written to the folder that driver and executors share.

    The folder is the one named in spark.checkpoint.dir. Where that is unset, a local run
    (tests) makes one of its own, and a cluster is refused, as its machines share no such folder. Written tables cut the lineage, survive
    the loss of executors, and are dropped as soon as a later table replaces them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark.conf.get("spark.master"))
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, frame: DataFrame, *by: str) -> DataFrame:
        """The frame as a written table, in folders by the last columns, if named."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        frame.write.partitionBy(*by).parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes saved tables that nothing lazy depends on any more."""
        for frame in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(frame._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
