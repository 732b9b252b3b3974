"""A keyed table that grows by runs: a base and the batches since, merged when they are read.

    <path>/base-<number>/bucket=<b>/..   the table as it stood when it was last compacted
    <path>/run-<number>/bucket=<b>/..    a batch: the last row of each of its keys, deletions as such
    <path>/manifest/<version>.json       what the table consists of: its base, its runs, the last batch it has

A batch writes itself and a manifest, nothing else, however large the table is.  Manifests are added, never changed: the
newest that is whole counts, so a lost driver leaves the table as it was, and a batch that comes again is known by its
number and changes nothing.  When there are `most_runs` runs they and the base become a new base; versions before the
last `keep` are removed with their files, so readers of the last versions are not disturbed.

All parts are dealt by the keys' hash into the same buckets, which are folders: looking up keys opens theirs only.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER, RUN, GONE = "_order", "_run", "_gone"


class KeyedTable:
    """keys: the columns of the key; order: a column by which a key's later row is known (ties: the later batch wins)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = 16, most_runs: int = 8, keep: int = 2) -> None:
        self.spark, self.path, self.keys, self.order = spark, path, keys, order
        self.buckets, self.most_runs, self.keep = buckets, most_runs, keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifests

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "base": None, "runs": [], "last": -1, "schema": None, "buckets": self.buckets}
        line = self.spark.read.text(f"{self.path}/manifest/{version or versions[-1]:010d}.json", wholetext=True).first()
        return json.loads(line[0])

    def _commit(self, manifest: dict) -> None:
        """Put the next manifest in its place by renaming, so that it is there whole or not at all."""
        manifest = manifest | {"version": manifest["version"] + 1}
        final, draft = (self._path(f"{self.path}/manifest/{'_' * k}{manifest['version']:010d}.json") for k in (0, 1))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer has made version {manifest['version']} of {self.path}")

    # -- reading

    def _parts(self, manifest: dict, buckets: list[int] | None) -> DataFrame:
        names = ([manifest["base"]] if manifest["base"] else []) + manifest["runs"]
        found = None
        for name in names:
            part = self.spark.read.schema(manifest["schema"]).parquet(f"{self.path}/{name}")
            part = part if buckets is None else part.filter(F.col("bucket").isin(buckets))
            found = part if found is None else found.unionByName(part)
        return found

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.keys)), F.lit(buckets)).cast("int")

    def _merged(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """The last row of each key, deleted ones among them."""
        parts = self._parts(manifest, buckets)
        rest = [c for c in parts.columns if c not in self.keys]
        last = F.max_by(F.struct(*rest), F.struct(ORDER, RUN)).alias("_r")
        return parts.groupBy(*self.keys).agg(last).select(*self.keys, "_r.*")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of its newest version or another that is still kept; None if nothing was ever written."""
        manifest = self.manifest(version)
        return None if manifest["schema"] is None else self._merged(manifest).filter(f"not {GONE}").drop(ORDER, RUN, GONE, "bucket")

    def lookup(self, keys: Iterable[tuple]) -> DataFrame | None:
        """The rows of a few keys; only their buckets are opened."""
        manifest = self.manifest()
        if manifest["schema"] is None:
            return None
        kinds = {f.split(" ", 1)[0].strip("`"): f.split(" ", 1)[1] for f in manifest["kinds"]}
        wanted = self.spark.createDataFrame([tuple(k) for k in keys], ", ".join(f"`{k}` {kinds[k]}" for k in self.keys))
        buckets = sorted({r[0] for r in wanted.select(self._bucket(manifest["buckets"])).collect()})
        return self._merged(manifest, buckets).filter(f"not {GONE}").join(F.broadcast(wanted), self.keys, "left_semi").drop(ORDER, RUN, GONE, "bucket")

    # -- writing

    def append(self, batch: DataFrame, number: int, deleted: str | None = None) -> bool:
        """Add a batch under its number; False if the table has it already.  deleted: a boolean column that takes keys out."""
        manifest = self.manifest()
        if number <= manifest["last"]:
            return False
        gone = F.lit(False) if deleted is None else F.coalesce(F.col(deleted), F.lit(False))
        rest = [c for c in batch.columns if c not in self.keys]
        rows = batch.withColumn(ORDER, F.col(self.order)).withColumn(GONE, gone)
        last = F.max_by(F.struct(*rest, ORDER, GONE), F.struct(ORDER, *(F.col(c) for c in rest if c != self.order and dict(batch.dtypes)[c][:3] != "map"))).alias("_r")
        rows = rows.groupBy(*self.keys).agg(last).select(*self.keys, "_r.*").withColumn(RUN, F.lit(number).cast("long"))
        name = f"run-{number:010d}"
        schema = self._write(rows, name, manifest["buckets"])
        self._commit(manifest | {"runs": [*manifest["runs"], name], "last": number, "schema": schema, "kinds": [f"{n} {t}" for n, t in batch.dtypes]})
        if len(manifest["runs"]) + 1 >= self.most_runs:
            self.compact()
        return True

    def _write(self, rows: DataFrame, name: str, buckets: int) -> str:
        rows = rows.withColumn("bucket", self._bucket(buckets))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")
        return ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def compact(self, settled: Column | None = None) -> None:
        """Base and runs into a new base.

        A deletion stays as long as an older row of its key may still come; settled: a condition on the row that
        deleted a key under which none will, so that it can leave.
        """
        manifest = self.manifest()
        if manifest["schema"] is None or not manifest["runs"]:
            return
        name = f"base-{manifest['version'] + 1:010d}"
        rows = self._merged(manifest).drop("bucket")
        self._write(rows if settled is None else rows.filter(~(F.col(GONE) & settled)), name, manifest["buckets"])
        self._commit(manifest | {"base": name, "runs": []})
        self._clean()

    def _clean(self) -> None:
        """Versions before the last `keep`, and files that no kept version has."""
        versions = self._versions()
        kept = [self.manifest(v) for v in versions[-self.keep :]]
        named = {n for m in kept for n in ([m["base"]] if m["base"] else []) + m["runs"]}
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith(("base-", "run-")) and name not in named:
                self._fs.delete(status.getPath(), True)
        for v in versions[: -self.keep]:
            self._fs.delete(self._path(f"{self.path}/manifest/{v:010d}.json"), False)
