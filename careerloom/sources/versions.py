"""Tables in immutable versions, and a manifest that says which of them count."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerloom.runtime import remove

_KEYS = "__keys"


class VersionedTables:
    """Named tables of rows that belong to a key (a session, say), replaced key by key.

    A commit writes the keys it replaces and their new rows to a folder of its
    own and then, as its last act, one small file into the manifest; Spark's
    writers make such a file appear whole or not at all. Readers take every
    key's rows from the newest commit that names the key, and nothing from
    folders without a commit: a write that failed half-way changes nothing for
    them, and one that is repeated replaces nothing twice.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("session_id",)):
        self.spark, self.path, self.keys = spark, path, list(keys)

    def commits(self) -> dict[int, tuple[str, bool, str]]:
        """Version -> (folder, whether it holds all older ones, note) of what counts: the newest whole version and all after it.

        One entry per commit since the last compaction.
        """
        try:
            rows = self.spark.read.schema("version long, folder string, base boolean, note string").json(f"{self.path}/manifest").collect()
        except AnalysisException:
            return {}
        out: dict[int, tuple[str, bool, str]] = {}
        # Of two commits of one version the whole one counts, else the smaller folder name, the same for all readers.
        for r in sorted(rows, key=lambda r: (r.version, not r.base, r.folder)):
            out.setdefault(r.version, (r.folder, r.base, r.note))
        first = max((v for v, c in out.items() if c[1]), default=None)
        return {v: c for v, c in out.items() if first is None or v >= first}

    def commit(self, version: int, touched: DataFrame, base: bool = False, note: str = "", **tables: DataFrame) -> None:
        """Replace the rows of the ``touched`` keys by those of ``tables``; a version that is there already stays as it is."""
        known = self.commits()
        if not base and (version in known or version <= max((v for v, c in known.items() if c[1]), default=-1)):
            return
        folder = f"v{version}-{uuid.uuid4().hex}"
        touched.select(*self.keys).distinct().write.parquet(f"{self.path}/{folder}/{_KEYS}")
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        line = [(version, folder, base, note)]
        manifest = self.spark.createDataFrame(line, "version long, folder string, base boolean, note string").coalesce(1)
        manifest.write.mode("append").json(f"{self.path}/manifest")

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.path}/{f}/{name}" for f in folders])
        version = F.regexp_extract(F.col("_metadata.file_path"), rf"/v(\d+)-[0-9a-f]+/{name}/", 1).cast("long")
        return rows.select("*", version.alias("__version"))

    def read(self, name: str) -> DataFrame:
        """Every key's rows as of its newest commit."""
        folders = [c[0] for c in self.commits().values()]
        if not folders:
            raise FileNotFoundError(f"nothing is committed to {self.path}")
        rows = self._read(name, folders)
        if len(folders) == 1:
            return rows.drop("__version")
        newest = self._read(_KEYS, folders).groupBy(*self.keys).agg(F.max("__version").alias("__version"))
        return rows.join(newest, [*self.keys, "__version"], "left_semi").drop("__version")

    def compact(self, *names: str) -> None:
        """Write what counts as one whole version under the newest number; older folders are no longer read."""
        known = self.commits()
        if len(known) < 2:
            return
        keys = self._read(_KEYS, [c[0] for c in known.values()]).select(*self.keys)
        self.commit(max(known), keys, base=True, **{n: self.read(n) for n in names})

    def vacuum(self) -> list[str]:
        """Delete the folders of versions that no longer count; for times when nobody reads them."""
        live = {c[0] for c in self.commits().values()}
        all_ = {r.folder for r in self.spark.read.schema("folder string").json(f"{self.path}/manifest").collect()}
        for folder in all_ - live:
            remove(self.spark, f"{self.path}/{folder}")
        return sorted(all_ - live)
