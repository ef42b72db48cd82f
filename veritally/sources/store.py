"""Results by month, written whole or not at all.

Every table lies under ``base/<table>/month=YYYY-MM/run=<id>/``. A run writes all its tables and
then, for each month of which it wrote all that every month has, the marker of the month's next
version, ``base/finished/month=YYYY-MM/v<number>``; readers see the run that the latest marker names and
nothing else, so a run lost half-way, or still going, is invisible. Markers are created only where there is none:
of two runs that began at the same version of a month, one wins and the other is refused. A month
that goes gets a marker without a run, and then its files are deleted.

Months by folders are many small files. ``compact`` writes all finished months of a table into a few sorted files
under ``base/packed/<id>/<table>/`` and gives each month a version that names them; ``clean`` deletes what no
month names any more, after a grace period for those still reading it.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "month string, run string"
# What a marker says of a month that is gone. An empty one was never completed and counts as absent.
GONE = "-"
# Versions that lie in packed files, many months together, begin like this.
PACKED = "packed-"
TABLES = ("quality", "daily", "hourly", "zones", "facts", "examples")
# A month may have no example, and no trip with a zone; the other tables have rows for every month.
SPARSE = ("zones", "examples")
# The order of rows within a month, by which files are sorted.
ORDERS = {
    "quality": ("rule", "company", "day"), "daily": ("day", "company", "borough"), "hourly": ("company", "borough", "dow", "hour"),
    "zones": ("company", "trips"), "facts": (), "examples": ("rule", "rank"),
}
TARGET_BYTES = 128 << 20


class Conflict(RuntimeError):
    """Another run has finished a month since this one began."""


class ResultStore:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self._current: dict[str, str] | None = None
        self._tables: dict[tuple, DataFrame] = {}
        self._seen: dict[str, dict[str, int]] = {}

    def new_run(self) -> str:
        """A run's id, by the time it begins; it may replace the versions of months that there are now."""
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self._seen[run] = {month: max(versions) for month, versions in self._versions().items()}
        return run

    def write(self, table: str, df: DataFrame, run: str, order: tuple[str, ...] = ()) -> None:
        """Sorted zstd parquet, one file a month: results are small whatever the input."""
        out = df.withColumn("run", F.lit(run)).repartition("month")
        if order:
            out = out.sortWithinPartitions("month", *order)
        (out.write.mode("append").partitionBy("month", "run").option("compression", "zstd")
         .parquet(f"{self.base}/{table}"))

    def finish(self, run: str, tables: tuple[str, ...] = TABLES, among: DataFrame | None = None) -> DataFrame:
        """Make visible the months of which this run wrote every table; the last thing a run writes.

        Of a run that writes some of the tables, `among` are the months that have the other ones, in a store of their own.
        Months that another run has finished meanwhile stay that run's, and are a Conflict at the end.
        """
        written = [self._written(table, run) for table in tables if table not in SPARSE] + ([] if among is None else [among])
        months = sorted(row["month"] for row in complete_months(written).collect())
        won = [month for month in months if self._mark(month, self._seen[run].get(month, 0) + 1, run)]
        self._current = None
        if len(won) < len(months):
            raise Conflict(f"run {run}: finished by another run meanwhile: {', '.join(sorted({*months} - {*won}))}")
        return self.spark.createDataFrame([(month,) for month in won], "month string")

    def _path(self, path: str):
        """A path and its file system; both belong to the session's JVM."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _mark(self, month: str, version: int, text: str) -> bool:
        """Create the marker of a month's version; False where there is one already."""
        path, system = self._path(f"{self.base}/finished/month={month}/v{version:08d}")
        if system.exists(path):
            return False
        try:
            out = system.create(path, False)
        except Exception as error:  # another run was faster
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _versions(self) -> dict[str, list[int]]:
        """Versions of each month; a line for each time a month was finished."""
        path, system = self._path(f"{self.base}/finished/month=*/v*")
        out: dict[str, list[int]] = {}
        for status in system.globStatus(path) or []:
            out.setdefault(status.getPath().getParent().getName()[6:], []).append(int(status.getPath().getName()[1:]))
        return out

    def _marked(self, month: str, version: int) -> str:
        path, system = self._path(f"{self.base}/finished/month={month}/v{version:08d}")
        file = system.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()

    def _written(self, table: str, run: str) -> DataFrame:
        """The months of a table that a run wrote, from its files' folders; none where it wrote nothing."""
        if not self._exists(f"{self.base}/{table}"):
            return self.spark.createDataFrame([], "month string")
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{self.base}/{table}")
        found = files.select(F.regexp_extract("path", r"/month=([^/]+)/run=([^/]+)/", 1).alias("month"), F.regexp_extract("path", r"/run=([^/]+)/", 1).alias("run"))
        return found.filter(F.col("run") == run).select("month").distinct()

    def _exists(self, path: str) -> bool:
        hadoop, system = self._path(path)
        return system.exists(hadoop)

    def finished(self) -> dict[str, str]:
        """Month → its latest finished run. A line per month of the calendar, so the driver can hold it."""
        if self._current is None:
            self._current = {}
            for month, versions in self._versions().items():
                said = next(filter(None, (self._marked(month, v) for v in sorted(versions, reverse=True))), GONE)
                if said != GONE:
                    self._current[month] = said
        return self._current

    def months(self) -> DataFrame:
        """The finished months. A run finishes a month only with all its tables written."""
        return self.spark.createDataFrame([(m,) for m in sorted(self.finished())], "month string")

    def read(self, table: str, months: list[str] | None = None) -> DataFrame:
        """A table's finished months: only their directories are listed and read."""
        wanted = {m: r for m, r in self.finished().items() if months is None or m in months}
        key = (table, tuple(sorted(wanted.items())))
        if key not in self._tables:
            packed: dict[str, list[str]] = {}
            for month, run in sorted(wanted.items()):
                if run.startswith(PACKED):
                    packed.setdefault(run, []).append(month)
            paths = [f"{self.base}/{table}/month={m}/run={r}" for m, r in sorted(wanted.items()) if r not in packed]
            whole = [(f"{self.base}/packed/{run}/{table}", own) for run, own in packed.items()]
            if table in SPARSE:
                paths = [p for p in paths if self._exists(p)]
                whole = [(p, own) for p, own in whole if self._exists(p)]
            parts = [self._folders(table, paths).drop("run")] if paths else []
            # Files are sorted by month, so this filter reaches only the row groups that hold one of them.
            parts += [self.spark.read.parquet(path).where(F.col("month").isin(own)) for path, own in whole]
            if not parts:
                raise FileNotFoundError(f"no finished month of {table} in {self.base}")
            self._tables[key] = reduce(DataFrame.unionByName, parts)
        return self._tables[key]

    def _folders(self, table: str, paths: list[str]) -> DataFrame:
        """Rows under folders of months and runs. These stay text: inference would read 2026-06 as a date."""
        rows = self.spark.read.option("basePath", f"{self.base}/{table}").parquet(*paths)
        month = F.date_format("month", "yyyy-MM") if dict(rows.dtypes)["month"] == "date" else F.col("month")
        return rows.withColumn("month", month).withColumn("run", F.col("run").cast("string"))

    def read_written(self, table: str) -> DataFrame:
        """A table's rows of each month's finished run, and of the latest run where none has finished the month."""
        path, system = self._path(f"{self.base}/{table}/month=*/run=*/*.parquet")
        if not system.globStatus(path):  # all its months are packed
            return self.read(table)
        rows = self._folders(table, [f"{self.base}/{table}"]).where(~F.col("month").isin(list(self.finished())))
        latest = rows.groupBy("month").agg(F.max("run").alias("run"))
        rest = rows.join(latest, ["month", "run"], "left_semi").drop("run")
        return rest.unionByName(self.read(table)) if self.finished() else rest

    def compact(self, target: int = TARGET_BYTES, tables: tuple[str, ...] = TABLES) -> list[str]:
        """Write the finished months into files of about ``target`` bytes; the months that now lie there.

        Nothing where every month already lies in the same files. A month that a run finishes meanwhile
        stays that run's; a run that began before is refused a month that was packed meanwhile, and is run again.
        """
        before = dict(self.finished())
        if not before or (len(set(before.values())) == 1 and next(iter(before.values())).startswith(PACKED)):
            return []
        packed = f"{PACKED}{self.new_run()}"
        seen = self._seen[packed.removeprefix(PACKED)]
        for table in tables:
            try:
                rows = self.read(table)
            except FileNotFoundError:  # a sparse table without a row in any month
                continue
            files = rows.inputFiles()
            size = sum(system.getFileStatus(path).getLen() for path, system in map(self._path, files))
            order = [c for c in ORDERS[table] if c in rows.columns]
            # By month and order, not by month alone: a large month may fill several files.
            dealt = rows.repartitionByRange(max(1, -(-size // target)), "month", *order).sortWithinPartitions("month", *order)
            dealt.write.option("compression", "zstd").parquet(f"{self.base}/packed/{packed}/{table}")
        # Only months that are as they were read: their versions have not grown since.
        won = [month for month in sorted(before) if self._mark(month, seen.get(month, 0) + 1, packed)]
        self._current = None
        return won

    def clean(self, grace: float) -> list[str]:
        """Delete folders of runs that no month names; those deleted.

        What began less than ``grace`` seconds ago stays, as it may still be written; and what was replaced less than so
        long ago, as it may still be read. Grace has to be longer than any run.
        """
        self._current = None
        current, now, gone = set(self.finished().items()), time.time(), []
        named = {run for _, run in current}
        markers, system = self._path(f"{self.base}/finished/month=*/v*")
        replaced: dict[str, float] = {}
        for marker in system.globStatus(markers) or []:
            month, at = marker.getPath().getParent().getName()[6:], marker.getModificationTime() / 1000
            replaced[month] = max(at, replaced.get(month, 0.0))
        folders = [f"{self.base}/{table}/month=*/run=*" for table in TABLES] + [f"{self.base}/packed/*"]
        for path, system in map(self._path, folders):
            for status in system.globStatus(path) or []:
                folder = status.getPath()
                run, month = folder.getName().removeprefix("run="), folder.getParent().getName().removeprefix("month=")
                used = run in named if run.startswith(PACKED) else (month, run) in current
                began = int(run.removeprefix(PACKED)[:20]) / 1e9
                last = max(replaced.values(), default=0.0) if run.startswith(PACKED) else replaced.get(month, now)
                if not used and now - max(began, last) > grace:
                    system.delete(folder, True)
                    gone.append(folder.toString())
        return sorted(gone)

    def publish(self, name: str, df: DataFrame) -> None:
        """Replace a small table that spans months. Readers take the latest one written whole."""
        path = f"{self.base}/across/{name}/{self.new_run()}"
        df.repartition(1).write.option("compression", "zstd").parquet(path)
        self.spark.createDataFrame([(name, path)], MARKER).repartition(1).write.mode("append").parquet(
            f"{self.base}/published"
        )

    def published(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(MARKER).parquet(f"{self.base}/published").where(F.col("month") == name)
        return self.spark.read.parquet(rows.agg(F.max("run")).first()[0])

    def retire(self, stale: list[str], confirmed: bool) -> list[str]:
        """Delete months outside a window; nothing unless the window is confirmed."""
        if not confirmed or not stale:
            return []
        # Markers without a run come first: a month half deleted is then not visible.
        versions = self._versions()
        lost = [month for month in stale if not self._mark(month, max(versions.get(month, [0])) + 1, GONE)]
        self._current = None
        if lost:
            raise Conflict(f"finished by another run meanwhile: {', '.join(lost)}")
        for table in TABLES:
            for month in stale:
                path, system = self._path(f"{self.base}/{table}/month={month}")
                system.delete(path, True)
        return stale


def complete_months(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, [t.select("month") for t in tables])


def prefer(primary: DataFrame, cached: DataFrame) -> DataFrame:
    """Both tables' months; where both have one, the primary's rows."""
    return primary.unionByName(cached.join(primary.select("month").distinct(), "month", "left_anti"))


def documents(facts: DataFrame, examples: DataFrame) -> DataFrame:
    """(month, document): one JSON text a month, its facts with the example records nested by rule and rank."""
    listed = examples.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("rule", "rank", "company", F.col("day").cast("string").alias("day"), "record"))).alias("examples"))
    whole = facts.join(listed, "month", "left").withColumn("examples", F.coalesce("examples", F.array().cast(listed.schema["examples"].dataType)))
    return whole.select("month", F.to_json(F.struct(*whole.columns), {"ignoreNullFields": "false"}).alias("document"))


def write_documents(df: DataFrame, path: str) -> None:
    """One file a month, in the month's folder."""
    df.select("month", F.col("document").alias("value")).repartition("month").write.mode("overwrite").partitionBy("month").text(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema("value string, month string").option("basePath", path).text(path).select(F.from_json("value", schema).alias("d")).select("d.*")
