"""Result store (S18): reports are written, audited and then published together.

A publication writes every report below a staging folder of its own, reads each
one back, compares rows and schema with what was written, and only then puts
one small manifest in place by an atomic rename.  Readers follow manifests, so
they see all reports of a version or none.  Publishing a version again replaces it
and removes what the replaced manifest named; a run that dies before the rename
leaves files that no manifest names, which ``sweep`` removes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Reports that are written at the same time: their jobs share the cluster.
WRITERS = 4


class AuditError(RuntimeError):
    """A staged report differs from what was written."""


class ResultStore:
    """Versions of named reports below one folder of a shared file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- files, by Hadoop's file system so that any store works ------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read_text(self, path) -> str:
        stream = self._files().open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _replace_text(self, text: str, *parts: str) -> None:
        """Writes beside the place and renames over it: readers see the old text or the new one."""
        target, beside = self._path(*parts), self._path(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        out = self._files().create(beside, True)
        out.write(text.encode())
        out.close()
        jvm = self.spark._jvm
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        where = self._files().makeQualified(target)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration()).rename(
            self._files().makeQualified(beside), where, over)

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        if not self._files().exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._files().listStatus(path))

    # --- write, audit, publish ---------------------------------------------------------------
    def _stage(self, report: str, df: DataFrame, folder: str) -> dict:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.root}/{folder}/{report}")
        return {"report": report, "path": f"{folder}/{report}", "rows": seen.get["rows"], "schema": df.schema.jsonValue()}

    def _audit(self, entry: dict) -> None:
        """Reads a staged report back: all rows are there, in the columns and types that were written."""
        back = self.spark.read.parquet(f"{self.root}/{entry['path']}")
        want = [(f["name"], f["type"]) for f in entry["schema"]["fields"]]
        have = [(f["name"], f["type"]) for f in back.schema.jsonValue()["fields"]]
        if [n for n, _ in want] != [n for n, _ in have] or [_plain(t) for _, t in want] != [_plain(t) for _, t in have]:
            raise AuditError(f"{entry['report']}: schema {have} in place of {want}")
        rows = back.count()
        if rows != entry["rows"]:
            raise AuditError(f"{entry['report']}: {rows} rows in place of {entry['rows']}")

    def publish(self, reports: dict[str, DataFrame], version: str,
                checks: dict[str, Callable[[DataFrame], bool]] | None = None) -> dict:
        """Writes, audits and publishes all ``reports`` as ``version``; the manifest.

        ``checks`` adds a condition on a staged report by its name; a failed check or audit publishes nothing.
        """
        if not reports or any(not n or n.startswith((".", "_")) or "/" in n for n in (*reports, version)):
            raise ValueError("reports and versions need plain names")
        folder = f"staging/{version}-{uuid.uuid4().hex}"
        with ThreadPoolExecutor(WRITERS) as pool:
            entries = list(pool.map(lambda item: self._stage(*item, folder), reports.items()))
            list(pool.map(self._audit, entries))
        for name, check in (checks or {}).items():
            if not check(self.spark.read.parquet(f"{self.root}/{folder}/{name}")):
                raise AuditError(f"{name}: check failed")
        before = self.manifest(version)
        manifest = {"version": version, "folder": folder, "reports": entries}
        self._commit(manifest)
        if before and before["folder"] != folder:
            self._files().delete(self._path(before["folder"]), True)
        return manifest

    def _commit(self, manifest: dict) -> None:
        self._files().mkdirs(self._path("manifests"))
        self._replace_text(json.dumps(manifest), "manifests", f"{manifest['version']}.json")

    def sweep(self) -> list[str]:
        """Removes staging folders that no manifest names (runs that died); not while a publication runs."""
        named = {self.manifest(v)["folder"] for v in self.versions()}
        dead = [n for n in self._names("staging") if f"staging/{n}" not in named]
        for n in dead:
            self._files().delete(self._path("staging", n), True)
        return dead

    # --- read --------------------------------------------------------------------------------
    def versions(self) -> list[str]:
        return [n[:-len(".json")] for n in self._names("manifests") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: str | None = None) -> dict | None:
        """The manifest of a version (default: the greatest one), None if it is not published."""
        known = self.versions()
        version = version or (known[-1] if known else None)
        return json.loads(self._read_text(self._path("manifests", f"{version}.json"))) if version in known else None

    def read(self, report: str, version: str | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        found = self.manifest(version) or {"reports": []}
        for entry in found["reports"]:
            if entry["report"] == report:
                return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{self.root}/{entry['path']}")
        raise KeyError(f"{report} is not published" + (f" in {version}" if version else ""))

    def catalog(self, version: str | None = None) -> DataFrame:
        """report, n_rows, n_columns, columns of a version, counted in the published files."""
        parts = []
        for entry in (self.manifest(version) or {"reports": []})["reports"]:
            df = self.read(entry["report"], version)
            parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(entry["report"]).alias("report"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
                F.lit(", ".join(sorted(df.columns))).alias("columns")))
        out = self.spark.createDataFrame([], "report string, n_rows long, n_columns int, columns string")
        for p in parts:
            out = out.unionByName(p)
        return out


def _plain(kind):
    """A type without the nullability that Parquet does not keep."""
    if isinstance(kind, dict):
        return {k: _plain(v) for k, v in kind.items() if k not in ("nullable", "containsNull", "valueContainsNull", "metadata")}
    return [_plain(v) for v in kind] if isinstance(kind, list) else kind
