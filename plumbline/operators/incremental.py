"""Processing only new or changed records: the target is the state.

Every output row stores the key and the version of the source record it was made from, so what is left to do is an
anti-join of the source against the target; there is no separate progress file that could disagree with the data.
A new target version becomes visible by the creation of one small file.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import _path, cut

#: The number of the version that wrote a row, kept beside it.
_SEQ = "_seq"
#: Lists of gone keys from which a version makes one.
MOST_LISTS = 8


def feature_key(version: str = "v1", target: str = "t64") -> Column:
    """The key under which a file's features are kept; null if a part is missing."""
    return F.concat_ws("|", "path", F.col("bytes").cast("string"), F.col("mtime_ns").cast("string"), F.lit(version), F.lit(target))


def complete_object(data: Column, field: str) -> Column:
    """Whether the text is exactly one complete JSON object that holds ``field`` (its value may be null)."""
    one = F.json_array_length(F.concat(F.lit("["), data, F.lit("]"))) == 1
    return F.coalesce(one & F.array_contains(F.json_object_keys(data), field), F.lit(False))


def done_keys(features: DataFrame, runs: DataFrame, field: str = "readable") -> DataFrame:
    """``key`` of each row of features which a succeeded run wrote and whose data is usable, perhaps repeated."""
    succeeded = runs.where(F.col("status") == "succeeded").select("run_id").distinct()
    rows = features.where(F.col("key").isNotNull() & complete_object(F.col("data"), field)).select("key", "run_id")
    return rows.join(succeeded, "run_id", "left_semi").select("key")


def pending(index: DataFrame, features: DataFrame, runs: DataFrame, version: str = "v1", target: str = "t64") -> DataFrame:
    """The files still to be extracted: file_id and key, each file once however often its row was delivered.

    A file without ``mtime_ns`` has no present state and is left out; one whose path or size is null has no key that a
    row could match and stays pending. Rows of failed, aborted or unknown runs and incomplete data count as absent.
    An empty features or runs table leaves every file pending.
    """
    files = index.where(F.col("mtime_ns").isNotNull())
    whole = F.col("path").isNotNull() & F.col("bytes").isNotNull()
    files = files.select("file_id", F.when(whole, feature_key(version, target)).alias("key"))
    return files.join(done_keys(features, runs), "key", "left_anti").dropDuplicates(["file_id"]).select("file_id", "key")


class Target:
    """A versioned table in a folder with at most one row per ``key``; ``version`` tells of which state of the source record a row was made.

    A published version is a small file ``_versions/<number>.json`` that lists the Parquet folders it consists of (parts) and lists of
    keys that later parts replaced (gone). A row of a part counts unless its key is gone with a later number, so a new state of a record
    replaces the old one without rewriting the part that holds it. Parts are merged with newer ones once those are as large, so there are about as many as the logarithm of the rows.
    The file of a version is created only if no other writer has created it (see ``_create``). Whatever a failed run left behind is
    in no version and so never read; ``vacuum`` removes it.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "key", version: str = "version"):
        self.spark, self.folder, self.key, self.state = spark, folder.rstrip("/"), key, version

    def _versions(self) -> list[int]:
        jpath, fs = _path(self.spark, f"{self.folder}/_versions")
        if not fs.exists(jpath):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(jpath)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")

    def _lists(self, version: int) -> dict:
        """The parts (oldest first, each with its folder, number and rows) and the folders of gone keys of a version."""
        if not version:
            return {"parts": [], "gone": []}
        jpath, fs = _path(self.spark, f"{self.folder}/_versions/{version:012d}.json")
        stream = fs.open(jpath)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self) -> int:
        """The number of the last published version; 0 if there is none."""
        return max(self._versions(), default=0)

    def read(self, schema: T.StructType, version: int | None = None) -> DataFrame:
        """The rows of a published version, by default the last; empty before the first."""
        lists = self._lists(self.version() if version is None else version)
        return self._alive([p["folder"] for p in lists["parts"]], lists["gone"], schema).drop(_SEQ)

    def _alive(self, parts: list[str], gone: list[str], schema: T.StructType) -> DataFrame:
        whole = T.StructType([*schema.fields, T.StructField(_SEQ, T.LongType())])
        if not parts:
            return self.spark.createDataFrame([], whole)
        rows = self.spark.read.schema(whole).parquet(*[f"{self.folder}/{p}" for p in parts])
        if not gone:
            return rows
        later = self._gone(gone, schema)
        return rows.join(later, (rows[self.key] == later[self.key]) & (rows[_SEQ] < later["_gone"]), "left_anti")

    def _gone(self, folders: list[str], schema: T.StructType) -> DataFrame:
        lists = self.spark.read.schema(T.StructType([schema[self.key], T.StructField("_gone", T.LongType())]))
        return lists.parquet(*[f"{self.folder}/{g}" for g in folders]).groupBy(self.key).agg(F.max("_gone").alias("_gone"))

    def publish(self, rows: DataFrame, base: int, schema: T.StructType | None = None) -> int:
        """Publishes version ``base`` with ``rows`` (non-null keys, each once) added, or put in the place of those with their keys, as
        version ``base + 1``. Raises ``FileExistsError`` if another run published that number meanwhile; its rows are then in the
        target, and the anti-join of the next run sees them."""
        number, schema = base + 1, schema or rows.schema
        name = lambda kind: f"{kind}-{number:012d}-{uuid.uuid4().hex}"
        lists, fresh = self._lists(base), name("part")
        rows.select(*[f.name for f in schema.fields], F.lit(number).cast("long").alias(_SEQ)).write.parquet(f"{self.folder}/{fresh}")
        own = self._alive([fresh], [], schema)
        size, parts, gone = own.count(), list(lists["parts"]), list(lists["gone"])
        merged = []
        while parts and parts[-1]["rows"] <= size:
            merged.append(parts.pop())
            size += merged[-1]["rows"]
        if parts:  # keys that older parts may hold
            old = self._alive([p["folder"] for p in parts], gone, schema)
            lost = cut(own.select(self.key).join(old.select(self.key), self.key, "left_semi").select(self.key, F.lit(number).cast("long").alias("_gone")))
            if len(gone) >= MOST_LISTS:
                lost, gone = lost.unionByName(self._gone(gone, schema)), []
            if not lost.isEmpty():
                gone.append(name("gone"))
                lost.write.parquet(f"{self.folder}/{gone[-1]}")
        if merged:
            # Rows of the merged parts keep the order of their numbers: all are older than what may be gone later.
            kept = self._alive([p["folder"] for p in merged], lists["gone"], schema).join(own.select(self.key), self.key, "left_anti")
            both = name("part")
            kept.withColumn(_SEQ, F.lit(number).cast("long")).unionByName(own).write.parquet(f"{self.folder}/{both}")
            fresh, size = both, self._alive([both], [], schema).count()
        parts.append({"folder": fresh, "rows": size})
        if not self._create(f"{number:012d}.json", json.dumps({"parts": parts, "gone": gone if len(parts) > 1 else []})):
            raise FileExistsError(f"version {number} of {self.folder} exists")
        return number

    def _create(self, name: str, text: str) -> bool:
        """Creates a file in ``_versions`` and tells whether it did; of several writers only one does. On a local disk by a hard link,
        which fails if the name is taken; on HDFS by a rename, which does too; elsewhere by creation without overwriting, which is
        exclusive where the store has conditional writes."""
        new, fs = _path(self.spark, f"{self.folder}/_versions/{name}")
        fs.mkdirs(new.getParent())
        if fs.getScheme() == "file":
            at = new.toUri().getPath()
            staged = f"{os.path.dirname(at)}/.{uuid.uuid4().hex}.staged"
            with open(staged, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(staged, at)
            except FileExistsError:
                return False
            finally:
                os.unlink(staged)
            return True
        renames = fs.getScheme() in ("hdfs", "viewfs")
        first = _path(self.spark, f"{self.folder}/_versions/.{uuid.uuid4().hex}.staged")[0] if renames else new
        try:
            out = fs.create(first, False)
        except Exception as x:
            if "exist" in str(x).lower():
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if renames and not fs.rename(first, new):
            fs.delete(first, False)
            return False
        return True

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the folders that none of the last ``keep`` versions lists, and the files of older versions. Folders of a run that
        builds on the last version bear a later number and stay."""
        versions = self._versions()
        if not versions:
            return []
        used = {x for v in versions[-keep:] for lists in [self._lists(v)] for x in [*(p["folder"] for p in lists["parts"]), *lists["gone"]]}
        jpath, fs = _path(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(jpath)]
        old = [n for n in names if n.split("-")[0] in ("part", "gone") and n not in used and int(n.split("-")[1]) <= versions[-1]]
        for v in versions[:-keep]:
            fs.delete(_path(self.spark, f"{self.folder}/_versions/{v:012d}.json")[0], False)
        for n in old:
            fs.delete(_path(self.spark, f"{self.folder}/{n}")[0], True)
        return old


def changed(source: DataFrame, done: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """The rows of ``source`` whose present state is not in ``done`` (key and version), each key once. Of several source rows with one key the one with the
    largest version is its present state; a key without a version has no known state and is always due; rows without a key are left out."""
    states = source.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(version).alias(version))
    due = states.join(done.select(key, version), [key, version], "left_anti")
    s, d = source.alias("s"), due.alias("d")
    rows = s.join(d, (F.col(f"s.{key}") == F.col(f"d.{key}")) & F.col(f"s.{version}").eqNullSafe(F.col(f"d.{version}")), "left_semi")
    return rows.dropDuplicates([key])


def run_once(source: DataFrame, target: Target, schema: T.StructType, transform) -> int:
    """One run: the source rows whose key and version are not in the target are transformed and published; a new version of a record takes
    the place of its old row. ``transform`` must keep the key and the version. Returns the number of the published version; a run that
    finds nothing to do, or fails, publishes nothing."""
    base = target.version()
    todo = changed(source, target.read(schema, base), target.key, target.state)
    if todo.isEmpty():
        return base
    return target.publish(transform(todo), base, schema)
