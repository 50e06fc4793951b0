"""Versions of datasets: data as Parquet, an index as JSON, and a fingerprint that does not depend on the order of rows."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.sources.storage import Storage, join


def fingerprint(df: DataFrame) -> str:
    """Equal for equal bags of rows, whatever their order and partitioning; repeats count.

    Every row is hashed with its columns in the order of their names; only sums of the hashes' parts and the number of
    rows meet, so nothing is sorted or collected.
    """
    cols = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in cols)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *(F.sum(p).alias(f"s{i}") for i, p in enumerate(parts))).first()
    body = json.dumps([cols, int(sums.n), *(str(sums[f"s{i}"] or 0) for i in range(8))])
    return hashlib.sha256(body.encode()).hexdigest()


@dataclass
class Version:
    version_id: str
    fingerprint: str
    path: str
    created_at: float
    documents: int
    fields: list[str]
    description: str = ""
    tags: list[str] = field(default_factory=list)
    parent: str | None = None
    branch: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)


class DatasetTracker:
    """Versions below one directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory, self._files = spark, directory, Storage(spark)
        self._files.make_folder(directory)
        self._index = join(directory, "versions.json")
        self.versions: dict[str, Version] = {}
        if self._files.exists(self._index):
            self.versions = {k: Version(**v) for k, v in json.loads(self._files.read(self._index)).items()}

    def _save(self) -> None:
        self._files.write(self._index, json.dumps({k: asdict(v) for k, v in self.versions.items()}, indent=2))

    def create(self, df: DataFrame, name: str | None = None, description: str = "", tags: Sequence[str] = (), parent: str | None = None, **metadata: Any) -> str:
        """The id of a new version, or of the existing one with the same rows."""
        mark = fingerprint(df)
        for v in self.versions.values():
            if v.fingerprint == mark and v.branch is None:
                return v.version_id
        now = time.time()
        stem = f"{name}_{int(now)}" if name else time.strftime("v_%Y%m%d_%H%M%S", time.gmtime(now))
        vid = f"{stem}_{mark[:8]}"
        path = join(self.directory, vid)
        df.write.mode("overwrite").parquet(path)
        self.versions[vid] = Version(vid, mark, path, now, self.spark.read.parquet(path).count(), df.columns, description, list(tags), parent, None, metadata)
        self._save()
        return vid

    def get(self, vid: str) -> Version | None:
        return self.versions.get(vid)

    def list(self, tags: Sequence[str] = ()) -> list[Version]:
        """Newest first; any of the tags."""
        found = [v for v in self.versions.values() if not tags or set(tags) & set(v.tags)]
        return sorted(found, key=lambda v: (-v.created_at, v.version_id))

    def load(self, vid: str) -> DataFrame:
        return self.spark.read.parquet(self.versions[vid].path)

    def export(self, vid: str, path: str, kind: str = "jsonl") -> None:
        if kind not in ("json", "jsonl"):
            raise ValueError(f"unknown format: {kind}")
        self.load(vid).write.mode("overwrite").json(path)

    def delete(self, vid: str, force: bool = False) -> bool:
        """The only version needs ``force``; data that a branch still points to stays."""
        if vid not in self.versions or (len(self.versions) == 1 and not force):
            return False
        v = self.versions.pop(vid)
        if all(o.path != v.path for o in self.versions.values()):
            self._files.delete(v.path)
        self._save()
        return True

    def compare(self, a: str, b: str, rows: bool = False) -> dict[str, Any]:
        x, y = self.versions[a], self.versions[b]
        out = {"identical": x.fingerprint == y.fingerprint, "document_difference": y.documents - x.documents, "new_fields": sorted(set(y.fields) - set(x.fields)), "removed_fields": sorted(set(x.fields) - set(y.fields))}
        if rows and x.fields == y.fields:
            out["only_in_first"], out["only_in_second"] = self.load(a).exceptAll(self.load(b)).count(), self.load(b).exceptAll(self.load(a)).count()
        return out

    def branch(self, vid: str, name: str) -> str:
        """A new version with the same data under another name."""
        v = self.versions[vid]
        bid = f"{name}_{int(time.time())}_{v.fingerprint[:8]}"
        self.versions[bid] = Version(bid, v.fingerprint, v.path, time.time(), v.documents, v.fields, f"branch of {vid}", list(v.tags), vid, name)
        self._save()
        return bid

    def summary(self) -> dict[str, Any]:
        newest = self.list()
        size = sum(f.size for p in {v.path for v in newest} for f in self._files.files(p))
        return {"versions": len(newest), "latest": newest[0].version_id if newest else None, "tags": sorted({t for v in newest for t in v.tags}), "bytes": size}

    def cleanup(self, keep: int) -> list[str]:
        old = [v.version_id for v in self.list()[keep:]]
        for vid in old:
            self.delete(vid)
        return old


class Stages:
    """Stages with a written table after each; a stage is taken from its table when nothing before it has changed."""

    def __init__(self, spark: SparkSession, directory: str, key: str):
        self.spark, self.directory, self._files = spark, directory, Storage(spark)
        self.key = key
        self._manifest = join(directory, "stages.json")
        self._files.make_folder(directory)

    def _read(self) -> list[dict[str, Any]]:
        return json.loads(self._files.read(self._manifest)) if self._files.exists(self._manifest) else []

    def _write(self, rows: list[dict[str, Any]]) -> None:
        self._files.write(self._manifest, json.dumps(rows, indent=2))

    def path(self, stage: str) -> str:
        return join(self.directory, f"{stage}_{self.key[:12]}")

    def has(self, stage: str) -> bool:
        return any(r["stage"] == stage and r["key"] == self.key and r["status"] == "done" for r in self._read())

    def save(self, stage: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(stage))
        self._note(stage, "done", "")
        return self.spark.read.parquet(self.path(stage))

    def _note(self, stage: str, status: str, error: str) -> None:
        rows = [r for r in self._read() if (r["stage"], r["key"]) != (stage, self.key)]
        self._write([*rows, {"stage": stage, "key": self.key, "status": status, "error": error, "at": time.time(), "path": self.path(stage)}])

    def run(self, stages: dict[str, Any], df: DataFrame | None = None, resume: bool = True) -> DataFrame:
        """Every stage on the one before; an error is noted and raised again."""
        names = list(stages)
        start = max((i + 1 for i, n in enumerate(names) if self.has(n)), default=0) if resume else 0
        if start:
            df = self.spark.read.parquet(self.path(names[start - 1]))
        for n in names[start:]:
            try:
                df = self.save(n, stages[n](df))
            except Exception as e:
                self._note(n, "error", str(e)[:500])
                raise
        return df

    def status(self) -> dict[str, str]:
        return {r["stage"]: r["status"] for r in self._read() if r["key"] == self.key}

    def cleanup(self, keep: int = 3) -> list[str]:
        """For each stage, the newest ``keep`` tables stay."""
        rows = sorted(self._read(), key=lambda r: -r["at"])
        seen: dict[str, int] = {}
        kept, gone = [], []
        for r in rows:
            seen[r["stage"]] = seen.get(r["stage"], 0) + 1
            (kept if seen[r["stage"]] <= keep else gone).append(r)
        for r in gone:
            self._files.delete(r["path"])
        self._write(sorted(kept, key=lambda r: r["at"]))
        return [r["path"] for r in gone]
