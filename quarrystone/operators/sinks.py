"""Table writes for plain parquet tables, which have no MERGE.

Writing rows and committing them are two steps: readers see the old version
until the second, and a failed check leaves them there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.clean import identifier


class VersionedTable:
    """A table under ``root/name``: folders of rows, and numbered commits that list the folders of a version.

    A commit is a file that must not exist yet, so of two writers that start
    from the same version one fails.  Appending adds a folder and never
    rewrites the others.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name = spark, identifier(name).replace("`", "")
        self.path = f"{root.rstrip('/')}/{self.name}"

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def latest(self) -> int:
        """The number of the newest commit; 0 before the first."""
        fs, path = self._file("_commits")
        if not fs.exists(path):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def folders(self, number: int) -> list[str]:
        text = self.spark.read.text(f"{self.path}/_commits/{number:08d}").collect()  # a few names
        return [r["value"] for r in text]

    def exists(self) -> bool:
        return self.latest() > 0

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/v={f}" for f in folders])

    def read(self, number: int | None = None) -> DataFrame:
        number = self.latest() if number is None else number
        if number == 0:
            raise LookupError(f"{self.name} has no published version")
        return self._rows(self.folders(number))

    def stage(self, df: DataFrame) -> str:
        """Write a folder that nobody sees yet."""
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/v={folder}")
        return folder

    def staged(self, folder: str) -> DataFrame:
        return self._rows([folder])

    def drop_stage(self, folder: str) -> None:
        fs, path = self._file(f"v={folder}")
        fs.delete(path, True)

    def promote(self, folders: str | Sequence[str], after: int) -> int:
        """Commit folders as the version that follows commit ``after``; an error if another writer did."""
        number = after + 1
        fs, path = self._file(f"_commits/{number:08d}")
        try:
            if self.latest() != after:
                raise RuntimeError(f"another writer published version {number} of {self.name}")
            out = fs.create(path, False)
        except Py4JJavaError as error:
            raise RuntimeError(f"another writer published version {number} of {self.name}") from error
        out.write(bytearray("\n".join([folders] if isinstance(folders, str) else folders).encode()))
        out.close()
        return number

    def retract(self, number: int) -> None:
        """Take back the newest commit, as when another table of the same publication failed."""
        if number == self.latest():
            fs, path = self._file(f"_commits/{number:08d}")
            fs.delete(path, False)

    def overwrite(self, df: DataFrame, after: int | None = None) -> None:
        after = self.latest() if after is None else after
        self._commit(df, [], after)

    def _commit(self, df: DataFrame, others: list[str], after: int) -> None:
        folder = self.stage(df)
        try:
            self.promote([*others, folder], after)
        except BaseException:
            self.drop_stage(folder)
            raise

    def append(self, df: DataFrame) -> None:
        at = self.latest()
        self._commit(df, self.folders(at) if at else [], at)

    def create_if_absent(self, schema_of: DataFrame) -> None:
        if not self.exists():
            self.overwrite(schema_of.limit(0))

    def insert_only(self, df: DataFrame, key: Sequence[str]) -> None:
        """Rows whose key is not there yet; copies inside ``df`` count once."""
        at, fresh = self.latest(), df.dropDuplicates(list(key))
        self._commit(fresh.join(self.read(at), list(key), "left_anti") if at else fresh, self.folders(at) if at else [], at)

    def upsert(self, df: DataFrame, key: Sequence[str]) -> None:
        """Matched rows replaced, others added; a key twice in ``df`` is an error, as in MERGE."""
        at = self.latest()
        if not df.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError("the source has a key twice")
        self.overwrite(self.read(at).join(df, list(key), "left_anti").unionByName(df) if at else df, at)

    def sync(self, df: DataFrame, key: Sequence[str]) -> None:
        """The table as the snapshot is: changed, added and deleted keys follow it."""
        at = self.latest()
        if not df.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError("the source has a key twice")
        self.overwrite(df, at)

    def vacuum(self, keep: int = 1) -> int:
        """Remove commits older than the last ``keep`` and the folders that only they list; how many folders went."""
        newest = self.latest()
        old = range(1, newest - max(keep, 1) + 1)
        live = {f for n in range(max(1, newest - max(keep, 1) + 1), newest + 1) for f in self.folders(n)}
        gone: set[str] = set()
        for number in old:
            fs, path = self._file(f"_commits/{number:08d}")
            if fs.exists(path):
                gone |= set(self.folders(number)) - live
                fs.delete(path, False)
        for folder in gone:
            self.drop_stage(folder)
        return len(gone)


def create_database(spark: SparkSession, name: str, use: bool = False) -> None:
    """The database if it is not there yet; ``use`` makes it the current one."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {identifier(name)}")
    if use:
        spark.sql(f"USE {identifier(name)}")


def publish(tables: Sequence[tuple[VersionedTable, DataFrame]], audit: Callable[[dict[str, DataFrame]], list[str]],
            policy: str = "hold", require_rows: bool = True) -> dict:
    """Write, audit, publish.  All tables are staged, audited and then promoted together.

    ``audit`` returns failure codes.  With ``hold`` any code keeps every table
    as it was; with ``warn`` codes are reported and the tables published.  If
    one table can't be promoted, those before it go back to where they were;
    stages that are not published are dropped, also when something raises.
    """
    if policy not in ("hold", "warn"):
        raise ValueError(policy)
    staged: list[tuple[VersionedTable, str, int]] = []
    done: list[tuple[VersionedTable, int]] = []
    published = False
    try:
        for table, df in tables:
            at = table.latest()
            staged.append((table, table.stage(df), at))
        frames = {t.name: t.staged(v) for t, v, _ in staged}
        codes = [f"EMPTY:{n}" for n, df in frames.items() if df.isEmpty()] if require_rows else []
        held = bool(codes)
        codes += audit(frames)
        if held or (policy == "hold" and codes):
            return {"status": "HELD", "codes": codes}
        for table, folder, at in staged:
            done.append((table, table.promote(folder, at)))
        published = True
        return {"status": "PUBLISHED", "codes": codes or ["ALL_CHECKS_PASSED"]}
    finally:
        if not published:
            for table, number in reversed(done):
                table.retract(number)
            for table, folder, _ in staged:
                table.drop_stage(folder)


def append_row(df: DataFrame, path: str) -> None:
    """Audit rows go to an append-only folder."""
    df.write.mode("append").parquet(path)


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The published layout: these columns, quoted, in this order."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
