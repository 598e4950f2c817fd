"""A small table that a stream rewrites: a ring of versions with pointers, all written and read by Spark."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SLOTS = 4  # versions that stay
_POINTER = "run long, batch long"


class Versions:
    """The versions of a table below ``path``, each named by (run, batch).

    A version is written to its slot first and then pointed at, so a reader sees whole
    versions only; a version that is written again takes its own slot again, and a new one
    the slot of the oldest.  Nothing is listed or deleted outside Spark.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def known(self) -> list[tuple[int, int, int]]:
        """(run, batch, slot) of the versions that are there, oldest first."""
        found = []
        for slot in range(SLOTS):
            try:
                rows = self.spark.read.schema(_POINTER).parquet(f"{self.path}/pointer/slot={slot}").collect()
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            found += [(r.run, r.batch, slot) for r in rows]
        return sorted(found)

    def newest_run(self) -> int:
        return max((run for run, _, _ in self.known()), default=0)

    def write(self, rows: DataFrame, run: int, batch: int) -> None:
        there = self.known()
        slots = {(r, b): slot for r, b, slot in there}
        slot = slots.get((run, batch), (there[-1][2] + 1) % SLOTS if there else 0)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/rows/slot={slot}")
        pointer = self.spark.createDataFrame([(run, batch)], _POINTER)
        pointer.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointer/slot={slot}")

    def read(self, run: int, batch: int) -> DataFrame:
        for r, b, slot in self.known():
            if (r, b) == (run, batch):
                return self.spark.read.parquet(f"{self.path}/rows/slot={slot}")
        raise ValueError(f"no version {(run, batch)} below {self.path}")

    def latest(self) -> DataFrame:
        there = self.known()
        if not there:
            raise ValueError(f"no version below {self.path}")
        return self.read(*there[-1][:2])
