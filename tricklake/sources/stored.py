"""Tables that are changed in place: buckets of files, and a manifest that says which files are the table.

A change writes new files for the buckets that it touches, then a manifest of its own number, put in place by one rename. Files of other buckets stay as they are and keep their names.
A run that is lost before the rename leaves the last manifest, and with it the old table, as it was; what it had written is removed by vacuum. Of two runs that change one table at once
the second finds its number taken and fails. Manifests list files, not rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables
from .folders import remove


class StoredTable:
    """A table below a path. Rows lie in the bucket of their first key, so what belongs to one first key is changed together."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _names(self, folder: str) -> list[tuple[str, int]]:
        where = self._jvm.Path(f"{self.path}/{folder}")
        return [(f.getPath().getName(), f.getLen()) for f in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def version(self) -> int:
        """Number of the last change; -1 without a table."""
        return max((int(n[1:-5]) for n, _ in self._names("manifest") if n.endswith(".json")), default=-1)

    def manifest(self) -> dict:
        n = self.version()
        if n < 0:
            raise FileNotFoundError(f"no table at {self.path}")
        lines = self.spark.read.text(f"{self.path}/manifest/v{n}.json", wholetext=True).first()
        return json.loads(lines.value)

    def _commit(self, manifest: dict, number: int) -> None:
        draft = self._jvm.Path(f"{self.path}/manifest/{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._jvm.Path(f"{self.path}/manifest/v{number}.json")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another run has changed {self.path}")

    # files

    def _bucket(self, m: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(m["keys"][0])), F.lit(m["buckets"])).cast("int")

    def _write(self, df: DataFrame, m: dict) -> dict[str, list]:
        """df as new files: bucket -> [name, bytes]. Large buckets are split among tasks."""
        part = f"data/{uuid.uuid4().hex}"
        df.withColumn("_bucket", self._bucket(m)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{part}")
        out: dict[str, list] = {}
        for folder, _ in self._names(part):
            if folder.startswith("_bucket="):
                out[folder[8:]] = [[f"{part}/{folder}/{n}", size] for n, size in self._names(f"{part}/{folder}") if n.endswith(".parquet")]
        return out

    def _read(self, m: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        files = [f"{self.path}/{n}" for b, fs in m["files"].items() if buckets is None or b in buckets for n, _ in fs]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    # the table

    def create(self, df: DataFrame, keys: list[str], buckets: int = 32) -> StoredTable:
        if self.version() >= 0:
            raise FileExistsError(self.path)
        m = {"keys": keys, "buckets": buckets, "schema": json.loads(df.schema.json()), "files": {}}
        self._commit(m | {"files": self._write(df, m)}, 0)
        return self

    def read(self) -> DataFrame:
        return self._read(self.manifest())

    def files(self) -> set[str]:
        return {n for fs in self.manifest()["files"].values() for n, _ in fs}

    def change(self, touching: DataFrame, make: Callable[[DataFrame], DataFrame]) -> int:
        """The buckets of touching's first keys become make(their rows); gives how many buckets that are. Nothing else is read or written."""
        number = self.version()
        m = self.manifest()
        touched = [str(r.b) for r in touching.select(self._bucket(m).alias("b")).distinct().collect()]  # buckets, a fixed number
        if touched:
            old = self._read(m, touched)
            new = make(old)
            if dict(new.dtypes) != dict(old.dtypes):
                raise TypeError(f"the table has {dict(old.dtypes)}, not {dict(new.dtypes)}")
            files = self._write(new.select(*old.columns), m)
            self._commit(m | {"files": {b: fs for b, fs in m["files"].items() if b not in touched} | files}, number + 1)
        return len(touched)

    def upsert(self, new: DataFrame) -> int:
        """Update rows of equal keys with the new non-null values, insert the others, as upsert of whole frames does."""
        keys = self.manifest()["keys"]
        return self.change(new, lambda old: tables.upsert(old, new, keys))

    def migrate_null_keys(self, wanted: DataFrame) -> int:
        """Rows with null in the other keys become a copy for each wanted key of the same first key."""
        first, *others = self.manifest()["keys"]
        return self.change(wanted, lambda old: tables.migrate_null_keys(old, wanted, first, others))

    def append(self, rows: DataFrame) -> None:
        """More rows in files of their own; columns that the table or the rows lack are null."""
        number, m = self.version(), self.manifest()
        have, new = T.StructType.fromJson(m["schema"]), rows.schema
        schema = T.StructType([*have, *(f for f in new if f.name not in have.names)])
        if wrong := [f.name for f in new if f.name in have.names and have[f.name].dataType != f.dataType]:
            raise TypeError(f"columns {wrong} are of another type")
        files = self._write(rows.select(*[F.col(f"`{f.name}`") if f.name in new.names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]), m)
        both = {b: m["files"].get(b, []) + files.get(b, []) for b in {*m["files"], *files}}
        self._commit(m | {"schema": json.loads(schema.json()), "files": both}, number + 1)

    def compact(self, most_bytes: int = 128 << 20, valid: Column | None = None) -> int:
        """Pack each bucket's files smaller than most_bytes into bins of that size; gives how many files were rewritten. Larger files, and small ones that stand alone, are not touched.

        With valid only rows for which it holds are kept, and every file is rewritten.
        """
        number, m = self.version(), self.manifest()
        bins, kept = [], {}
        for b, fs in m["files"].items():
            small = fs if valid is not None else [f for f in fs if f[1] < most_bytes]
            kept[b] = [f for f in fs if f not in small]
            mine: list[list] = []
            for f in sorted(small, key=lambda f: -f[1]):  # first fit, largest first
                place = next((x for x in mine if sum(s for _, s in x) + f[1] <= most_bytes), None)
                if place is None:
                    mine.append(place := [])
                place.append(f)
            for x in mine:
                if len(x) > 1 or valid is not None:
                    bins.append((b, x))
                else:
                    kept[b] += x
        if not bins:
            return 0
        names = {n: i for i, (_, fs) in enumerate(bins) for n, _ in fs}
        rows = self._read(m | {"files": {str(i): fs for i, (_, fs) in enumerate(bins)}})
        if valid is not None:
            rows = rows.where(valid)
        files = self._write(rows, m)
        for b in {b for b, _ in bins}:
            kept[b] = kept[b] + files.get(b, [])
        self._commit(m | {"files": {b: fs for b, fs in kept.items() if fs}}, number + 1)
        return len(names)

    def vacuum(self) -> int:
        """Remove files and drafts that no manifest but older ones names; only when no run is changing or reading the table. Gives how many folders and manifests went."""
        used, n, gone = {f.split("/")[1] for f in self.files()}, self.version(), 0
        for name, _ in self._names("data"):
            if name not in used:
                remove(self.spark, f"{self.path}/data/{name}")
                gone += 1
        for name, _ in self._names("manifest"):
            if name != f"v{n}.json":
                self._fs.delete(self._jvm.Path(f"{self.path}/manifest/{name}"), False)
                gone += 1
        return gone
