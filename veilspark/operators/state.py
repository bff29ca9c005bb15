"""Results kept between runs: a table of versions, each with a manifest that says what it is valid for.

A version is written aside and counts only once its manifest is there, so a run that breaks off leaves the version before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StateTable:
    """Versions of results under ``path``: data in folders of their own, manifests numbered from 1 on; the last ``keep`` stay."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), max(1, keep)

    def _fs(self, path: str):
        own = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return own, own.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        own, fs = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(own)) if fs.exists(own) else []

    def _delete(self, name: str) -> None:
        own, fs = self._fs(f"{self.path}/{name}")
        fs.delete(own, True)

    def manifests(self) -> list[dict]:
        """Complete manifests, the newest first; one that was broken off while it was written is none."""
        out = []
        for name in sorted((n for n in self._names("manifests") if n.endswith(".json")), reverse=True):
            lines = self.spark.read.text(f"{self.path}/manifests/{name}", wholetext=True).collect()  # one small file
            try:
                out.append(json.loads(lines[0][0]) if lines else None)
            except ValueError:
                out.append(None)
        return [m for m in out if m]

    def current(self, settings: dict | None = None) -> tuple[DataFrame, dict] | None:
        """The newest version and its manifest; None without one, or if it was made with other settings."""
        newest = next(iter(self.manifests()), None)
        if newest is None or (settings is not None and newest["settings"] != _plain(settings)):
            return None
        return self.spark.read.parquet(f"{self.path}/data/{newest['folder']}"), newest

    def write(self, rows: DataFrame, number: int) -> str:
        """Write a version aside; it doesn't count before publish()."""
        folder = f"{number:08d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def publish(self, folder: str, number: int, settings: dict, input_hash: str) -> None:
        """Swap a written version in.  A second writer of the same number fails, as its manifest is already there."""
        own, fs = self._fs(f"{self.path}/manifests/{number:08d}.json")
        stream = fs.create(own, False)
        try:
            stream.write(bytearray(json.dumps({"number": number, "folder": folder, "settings": _plain(settings), "input_hash": input_hash}).encode()))
        finally:
            stream.close()

    def prune(self) -> None:
        """Delete all versions but the last few, and what broken-off runs left."""
        kept = self.manifests()[: self.keep]
        for m in self.manifests()[self.keep :]:
            self._delete(f"manifests/{m['number']:08d}.json")
        for name in set(self._names("data")) - {m["folder"] for m in kept}:
            self._delete(f"data/{name}")

    def clear(self) -> None:
        """Start afresh: no version counts any more."""
        for name in self._names(""):
            self._delete(name)


def _plain(settings: dict) -> dict:
    return json.loads(json.dumps(settings, sort_keys=True))


def input_hash(samples: DataFrame, key: str = "hash") -> str:
    """One digest of all samples, whatever their order: their number, and the sum of the hashes of their keys."""
    n, total = samples.agg(F.count("*"), F.sum(F.xxhash64(key).cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}"


def resume(samples: DataFrame, process: Callable[[DataFrame], DataFrame], state: StateTable, settings: dict, key: str = "hash") -> DataFrame:
    """process() of every distinct sample, of which only those are worked off that the state doesn't have under the same settings.

    ``samples`` have a content hash in ``key``; process() keeps it.  Other settings (such as another k) make the whole state void, a
    changed text has another hash and so makes its own row void alone.  Rows of samples that are gone don't stay.  Each row has the
    number of the version in which it was worked off (column worked).  A null key is a key like any other.
    """
    own = input_hash(samples, key)
    have = state.current(settings)
    if have and have[1]["input_hash"] == own:
        return have[0]
    number = 1 + next((m["number"] for m in state.manifests()), 0)
    distinct = samples.dropDuplicates([key])
    todo, old = distinct, None
    if have:
        done = have[0].select(F.col(key).alias("_done"))
        same = distinct[key].eqNullSafe(F.col("_done"))
        todo = distinct.join(done, same, "left_anti")
        wanted = samples.select(F.col(key).alias("_wanted")).distinct()
        old = have[0].join(wanted, have[0][key].eqNullSafe(F.col("_wanted")), "left_semi")
    new = process(todo).withColumn("worked", F.lit(number).cast("long"))
    folder = state.write(new if old is None else old.select(new.columns).unionByName(new), number)
    state.publish(folder, number, settings, own)
    state.prune()
    return state.current(settings)[0]
