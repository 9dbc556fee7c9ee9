"""The seen ids as a bucketed table, which is joined without shuffling or scanning it twice.

``filter_seen`` over a plain table shuffles all ids of all times in each run.  Here they are filed by
the hash of the id, as Spark's shuffle would do it, so a run shuffles its own postings to them only.

Every run adds at most one file to a bucket.  When buckets hold more than a stated number of files,
``add`` writes the next generation, with one file in each bucket, and then the marker that makes it
the current one; a rewrite that broke off is never read.  One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitrank.sources.seen import SEEN_SCHEMA, new_ids

MARKS = "generation int, buckets int"


@dataclass(frozen=True)
class SeenTable:
    """Names the table in the catalogue of the session, and where its generations are.

    ``buckets`` is best the number of shuffle partitions of the runs, or more: with fewer Spark may
    choose to shuffle both sides.  It is fixed by the first generation.
    """

    spark: SparkSession
    name: str
    path: str
    buckets: int
    most_files: int = 16  # of a bucket, before the next generation is written

    def _marks(self) -> list:
        try:
            return self.spark.read.schema(MARKS).json(f"{self.path}/generations").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _declare(self, name: str, generation: int, buckets: int) -> None:
        """Register the folder of a generation; nothing is written, and dropping it deletes nothing."""
        folder = f"{self.path}/ids-{generation}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.spark.sql(
            f"CREATE TABLE {name} ({SEEN_SCHEMA}) USING parquet CLUSTERED BY (id) SORTED BY (id) "
            f"INTO {buckets} BUCKETS LOCATION '{folder}'"
        )

    def _current(self) -> tuple[int, int]:
        marks = self._marks()
        return max((m.generation, m.buckets) for m in marks) if marks else (0, self.buckets)

    def read(self) -> DataFrame:
        """The ids, each once, as a bucketed scan; empty before the first run."""
        generation, buckets = self._current()
        self._declare(self.name, generation, buckets)
        return self.spark.table(self.name)

    def _write(self, ids: DataFrame, name: str, buckets: int, overwrite: bool = False) -> None:
        filed = ids.repartition(buckets, "id").sortWithinPartitions("id")
        filed.write.insertInto(name, overwrite=overwrite)

    def add(self, raw: DataFrame) -> None:
        """Append the ids of all fetched rows that the table doesn't hold; null ids are left out.

        Only new ids are written, so a repeated call adds nothing.
        """
        known = self.read()
        self._write(new_ids(raw, known), self.name, self._current()[1])
        if self.files() > self.most_files * self._current()[1]:
            self.compact()

    def files(self) -> int:
        return len(self.read().inputFiles())

    def compact(self) -> None:
        """Write the next generation, one file for each bucket, and make it the current one."""
        generation, buckets = self._current()
        ids = self.read().distinct()
        following = f"{self.name}_next"
        self._declare(following, generation + 1, buckets)
        self._write(ids, following, buckets, overwrite=True)  # of what a broken rewrite left
        mark = self.spark.range(1).select(
            F.lit(generation + 1).alias("generation"), F.lit(buckets).alias("buckets")
        )
        mark.coalesce(1).write.mode("append").json(f"{self.path}/generations")
        self.spark.sql(f"DROP TABLE {following}")
