"""Tables that can be changed, with snapshots.

A table is a folder of immutable parquet segments and of numbered manifests, each
listing the segments of one version.  A statement writes new segments and then
creates the next manifest, which fails if another writer has created it; readers
of a version are never disturbed.  DELETE and UPDATE rewrite only segments that
hold rows they change; what they change is written down first, so it is evaluated once.

``begin`` puts off manifests: statements up to ``commit`` read and extend a
private list of segments, which becomes one version, or none after ``rollback``.

An index is the order of the rows within a segment and a bloom filter for each of its columns:
a lookup by constants, or a join's runtime filter, reads row groups that may match.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "_row"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, columns: dict[str, str]):
        self.spark, self.path, self.columns = spark, path.rstrip("/"), columns
        self.indexed: list[list[str]] = []
        self._staged: tuple[int, list[str]] | None = None
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if self.version() < 0:
            self._commit(0, [])

    @property
    def schema(self) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in self.columns.items())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """The newest version; -1 before the table is created."""
        folder = self._hadoop(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return -1
        return max((int(x.getPath().getName()) for x in self._fs.listStatus(folder)), default=-1)

    def begin(self) -> None:
        """Collect changes until ``commit`` or ``rollback``."""
        self._staged = (self.version(), self.segments())

    def commit(self) -> int:
        """Make one version of the changes since ``begin``; it fails if another writer was faster."""
        (version, segments), self._staged = self._staged, None
        return version if segments == self.segments(version) else self._commit(version + 1, segments)

    def rollback(self) -> None:
        self._staged = None

    def _commit(self, version: int, segments: list[str]) -> int:
        if self._staged is not None:
            self._staged = (self._staged[0], segments)
            return self._staged[0]
        stream = self._fs.create(self._hadoop(f"{self.path}/versions/{version}"), False)  # fails if it is there
        stream.write(bytearray(json.dumps(segments).encode()))
        stream.close()
        return version

    def segments(self, version: int | None = None) -> list[str]:
        if version is None and self._staged is not None:
            return self._staged[1]
        version = self.version() if version is None else version
        stream = self._fs.open(self._hadoop(f"{self.path}/versions/{version}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _rows(self, version: int | None = None) -> DataFrame:
        """Columns, row id and segment."""
        held = self.segments(version)
        stored = f"{self.schema}{', ' if self.columns else ''}`{ROW}` string"
        if not held:
            return self.spark.createDataFrame([], stored).withColumn("_segment", F.lit(""))
        df = self.spark.read.schema(stored).parquet(*[f"{self.path}/segments/{s}" for s in held])
        return df.withColumn("_segment", F.regexp_extract(F.col("_metadata.file_path"), "/segments/([0-9a-f]+)/", 1))

    def read(self, version: int | None = None) -> DataFrame:
        """A snapshot: the newest version, or any one before."""
        return self._rows(version).select(*[f"`{c}`" for c in self.columns])

    def with_rows(self) -> DataFrame:
        """The newest version with its row ids."""
        return self._rows().drop("_segment")

    def _write(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        if self.indexed:
            df = df.sortWithinPartitions(*[f"`{c}`" for c in self.indexed[0]])
        blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for columns in self.indexed for c in columns}
        df.write.options(**blooms).parquet(f"{self.path}/segments/{name}")
        return name

    def index(self, columns: list[str]) -> int:
        """Keep an index on ``columns`` from now on; rows that are there are written anew."""
        if columns not in self.indexed:
            self.indexed.append(columns)
        return self.compact()

    def compact(self) -> int:
        """Make one segment of all: a new version with the same rows."""
        held = self.segments()
        if not held:
            return self.version()
        return self._commit(self.version() + 1, [self._write(self._rows().drop("_segment"))])

    def _noted(self, df: DataFrame, columns: str) -> tuple[DataFrame, str]:
        """``df`` written down, and where: rows that are used several times are evaluated once."""
        path = f"{self.path}/noted/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(columns).parquet(path), path

    def _typed(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in self.columns.items()], F.expr("uuid()").alias(ROW))

    def insert(self, df: DataFrame, columns: list[str] | None = None) -> int:
        """Append rows, by position; columns that aren't named get NULL."""
        names = columns or list(self.columns)
        if len(df.columns) != len(names):
            raise ValueError(f"{len(names)} columns are wanted, not {len(df.columns)}")
        version, held = self.version(), self.segments()
        df = df.toDF(*names)
        for missing in (c for c in self.columns if c not in names):
            df = df.withColumn(missing, F.lit(None))
        return self._commit(version + 1, [*held, self._write(self._typed(df))])

    def _change(self, gone: DataFrame, new: DataFrame | None) -> int:
        """Replace rows (``gone`` has their ids) by new ones."""
        version, held = self.version(), self.segments()
        gone = gone.select(ROW).distinct()
        rows = self._rows()
        touched = [r[0] for r in rows.join(gone, ROW, "left_semi").select("_segment").distinct().collect()]  # one a segment
        if not touched and new is None:
            return self._commit(version + 1, held)
        left = rows.where(F.col("_segment").isin(touched)).join(gone, ROW, "left_anti").select(*[f"`{c}`" for c in self.columns], ROW)
        whole = left if new is None else left.unionByName(self._typed(new))
        return self._commit(version + 1, [*(s for s in held if s not in touched), self._write(whole)])

    def delete(self, gone: DataFrame) -> int:
        gone, path = self._noted(gone.select(ROW), f"`{ROW}` string")
        try:
            return self._change(gone, None)
        finally:
            self._fs.delete(self._hadoop(path), True)

    def update(self, changed: DataFrame) -> int:
        """``changed`` has a row id and all columns; a row that is changed twice is an error."""
        changed, path = self._noted(changed.select(ROW, *[F.col(f"`{c}`").cast(t) for c, t in self.columns.items()]), f"`{ROW}` string, {self.schema}")
        try:
            if changed.groupBy(ROW).count().where("count > 1").limit(1).count():
                raise ValueError("UPDATE matches a row more than once")
            return self._change(changed, changed.drop(ROW))
        finally:
            self._fs.delete(self._hadoop(path), True)
