"""Keyed tables that are added to batch by batch: a folder of Parquet batches and manifests that name the ones that count.

A batch is written to a folder of its own, then named by the next manifest, a file that can be created only once: of two writers
that commit at the same time one finds the number taken and takes the next. A batch whose name a manifest has already is not
written again, so a task, job or stream that is repeated changes nothing. Readers take the last manifest and, of each key, the
newest row. `compact` writes what is left of all batches as one. The names of all batches ever committed stay in the manifests.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tries to find a free number.
TRIES = 20


@dataclass(frozen=True)
class Store:
    """keys: what a row is known by. newest: the column that orders rows of a key; of equal ones, the later batch's row counts.
    gone: the name of a boolean column that marks a row as a deletion, if there is one."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    newest: str
    gone: str | None = None

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def manifest(self) -> dict:
        """The last manifest: version, batches (name, folder) that count, names of all that were ever committed."""
        jvm, fs, at = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(at, "manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        last = max((n for n in names if n.endswith(".json")), default=None)
        if last is None:
            return {"version": 0, "batches": [], "known": []}
        text = fs.open(jvm.org.apache.hadoop.fs.Path(folder, last))
        try:
            return json.loads(bytes(text.readAllBytes()).decode())
        finally:
            text.close()

    def _commit(self, change) -> bool:
        """Writes the manifest that change(last) gives; again, from the new last one, if another writer took its number."""
        jvm, fs, at = self._fs()
        for _ in range(TRIES):
            after = change(self.manifest())
            if after is None:
                return False
            to = jvm.org.apache.hadoop.fs.Path(at, f"manifests/{after['version']:09d}.json")
            try:
                out = fs.create(to, False)
            except Exception as e:
                if "AlreadyExists" in str(e):
                    continue
                raise
            out.write(json.dumps(after).encode())
            out.close()
            return True
        raise RuntimeError(f"no free manifest at {self.path}")

    def put(self, rows: DataFrame, batch: str) -> bool:
        """Adds rows as one batch; whether it was new. A batch that is there already is not even computed."""
        if batch in self.manifest()["known"]:
            return False
        folder = f"{self.path}/batches/{uuid.uuid4().hex}"
        rows.write.parquet(folder)

        def change(last: dict) -> dict | None:
            if batch in last["known"]:
                return None
            return {"version": last["version"] + 1, "batches": [*last["batches"], [batch, folder]], "known": [*last["known"], batch]}

        return self._commit(change)

    def read(self, since: Column | None = None) -> DataFrame | None:
        """The newest row of each key, but for deleted keys; with `since`, only rows as new as that. None if nothing was put."""
        batches = self.manifest()["batches"]
        if not batches:
            return None
        out = None
        for n, (_, folder) in enumerate(batches):
            part = self.spark.read.parquet(folder).withColumn("_batch", F.lit(n))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if since is not None:
            out = out.filter(F.col(self.newest) >= since)
        columns = [x for x in out.columns if x not in self.keys and x != "_batch"]
        best = out.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), F.struct(self.newest, "_batch")).alias("r")).select(*self.keys, "r.*")
        return best.filter(~F.coalesce(self.gone, F.lit(False))) if self.gone else best

    def compact(self, since: Column | None = None) -> bool:
        """One batch of what is left in place of all those that were there when it began; expired rows go with `since`."""
        before = self.manifest()["batches"]
        rows = self.read(since)
        if rows is None:
            return False
        folder = f"{self.path}/batches/{uuid.uuid4().hex}"
        rows.write.parquet(folder)

        def change(last: dict) -> dict | None:
            if last["batches"][: len(before)] != before:
                return None
            return {"version": last["version"] + 1, "batches": [["compacted", folder], *last["batches"][len(before) :]], "known": last["known"]}

        return self._commit(change)
