"""Tables in one folder that change together: each commit writes new folders, then one manifest that names them.

A manifest is published by a rename that fails if its number is taken, so readers see the old or the new version of all
tables, and of two writers one has to try again. A writer that dies before leaves folders that no manifest names. The folder
must be one that the driver and all executors share.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

NOTHING = {"version": 0, "tables": {}, "state": {}}


class Conflict(RuntimeError):
    """Another writer has published the version first."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        files, at = self._files(), self._path(folder)
        return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []

    def latest(self) -> dict:
        """The newest manifest: version, tables (name: folder and schema) and state."""
        numbers = [int(n) for n in self._names("manifests") if n.isdigit()]
        if not numbers:
            return NOTHING
        text = self.spark.read.option("wholetext", "true").text(f"{self.folder}/manifests/{max(numbers):012d}").first()[0]
        return json.loads(text)

    def version(self) -> int:
        return self.latest()["version"]

    def state(self, key: str, default: str | None = None) -> str | None:
        return self.latest()["state"].get(key, default)

    def has(self, name: str) -> bool:
        return name in self.latest()["tables"]

    def table(self, name: str, of: dict | None = None) -> DataFrame:
        """A table of the newest version, or of the manifest given; its rows stay the same when later versions are committed."""
        entry = (of or self.latest())["tables"][name]
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{self.folder}/data/{entry['folder']}")

    def commit(self, tables: dict[str, DataFrame], state: dict[str, str] | None = None, on: dict | None = None) -> int:
        """Replaces these tables and state values, keeps the others, and gives the new version's number.

        on: the manifest that the tables were computed from; if another version has been published since, Conflict is raised. A state
        value of None removes it.
        """
        old = on or self.latest()
        folder = f"v{old['version'] + 1}-{uuid.uuid4().hex}"
        new = {"version": old["version"] + 1, "tables": dict(old["tables"]), "state": dict(old["state"]) | (state or {})}
        new["state"] = {k: v for k, v in new["state"].items() if v is not None}
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/data/{folder}/{name}")
            new["tables"][name] = {"folder": f"{folder}/{name}", "schema": df.schema.jsonValue()}
        self._publish(new)
        return new["version"]

    def _publish(self, manifest: dict) -> None:
        files, draft = self._files(), self._path(f"manifests/draft-{uuid.uuid4().hex}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, self._path(f"manifests/{manifest['version']:012d}"), options)
        except Exception as e:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(e) or "rename destination" in str(e):
                raise Conflict(f"version {manifest['version']} of {self.folder} exists") from None
            raise

    def clean(self, keep: int = 2) -> int:
        """Deletes the manifests but for the newest `keep`, and data folders that no kept one names; the number of folders deleted.

        Not while another writer is at work: its folders are named by no manifest yet.
        """
        numbers = sorted((n for n in self._names("manifests") if n.isdigit()), key=int)
        files, used = self._files(), set()
        for n in numbers[-keep:]:
            text = self.spark.read.option("wholetext", "true").text(f"{self.folder}/manifests/{n}").first()[0]
            used |= {e["folder"].split("/")[0] for e in json.loads(text)["tables"].values()}
        for n in numbers[:-keep]:
            files.delete(self._path(f"manifests/{n}"), False)
        gone = [n for n in self._names("data") if n not in used]
        for n in gone:
            files.delete(self._path(f"data/{n}"), True)
        return len(gone)
