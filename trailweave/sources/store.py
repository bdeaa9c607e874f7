"""A memory that stays: versions of its tables in a folder that all share.

A version is a manifest, which names the tables' folders, and a ledger of the batches that it has taken in. Folders are
written first and never changed; the manifest of the next number comes last, and only one writer can make it. A reader
sees the version that was newest when it looked, whatever is written meanwhile. A table that has a `by` column is
bucketed and sorted by it, so that what joins, groups or ranks by that column reads it in place."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .shared import _hadoop


class Conflict(RuntimeError):
    """Another writer has made the version in the meantime."""


@dataclass(frozen=True)
class Version:
    """number: from 1, 0 for the empty memory; tables: by name its folder, schema, bucket column and buckets; ledger: by
    query the number of its last batch."""

    number: int = 0
    tables: Mapping[str, dict] = field(default_factory=dict)
    ledger: Mapping[str, int] = field(default_factory=dict)

    def has(self, batch: tuple[str, int] | None) -> bool:
        """Whether a batch is in already. Batches of a query are numbered in the order in which they come."""
        return batch is not None and self.ledger.get(batch[0], -1) >= batch[1]


class MemoryStore:
    """root: the folder. by: for tables that are bucketed their column; buckets: how many (None: as many as a shuffle
    has partitions), fixed by the first version, so that versions stay co-located."""

    def __init__(self, spark: SparkSession, root: str, by: Mapping[str, str] | None = None, buckets: int | None = None):
        self.spark, self.root, self.by = spark, root.rstrip("/"), dict(by or {})
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # Manifests ------------------------------------------------------------------------------------------------------

    def _manifest(self, number: int) -> str:
        return f"{self.root}/manifests/{number:012d}.json"

    def versions(self) -> list[int]:
        fs, at = _hadoop(self.spark, f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version by its number, or the newest; the empty one where there is none."""
        if number is None:
            number = max(self.versions(), default=0)
        if not number:
            return Version()
        fs, at = _hadoop(self.spark, self._manifest(number))
        stream = fs.open(at)
        try:
            said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, said["tables"], said["ledger"])

    def _publish(self, version: Version) -> None:
        """Makes the manifest visible, whole or not at all. The rename fails where the name is taken; it is atomic
        where that of the file system is."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs, draft = _hadoop(self.spark, f"{self.root}/drafts/{uuid.uuid4().hex}.json")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"tables": dict(version.tables), "ledger": dict(version.ledger)}).encode()))
        finally:
            out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests"))
        final = jvm.org.apache.hadoop.fs.Path(self._manifest(version.number))
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, final, options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {version.number} is there already") from e
            raise

    # Tables ---------------------------------------------------------------------------------------------------------

    def read(self, version: Version | None = None) -> dict[str, DataFrame]:
        """The tables of a version, of the newest if none is named."""
        return {name: self._table(told) for name, told in (version or self.version()).tables.items()}

    def _table(self, told: dict) -> DataFrame:
        schema = StructType.fromJson(told["schema"])
        if not told["by"]:
            return self.spark.read.schema(schema).parquet(told["path"])
        name = f"memory_{told['path'].rsplit('/', 1)[-1]}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{told['by']}`) SORTED BY (`{told['by']}`) INTO {told['buckets']} BUCKETS LOCATION '{told['path']}'")
        return self.spark.table(name)

    def _written(self, name: str, df: DataFrame, buckets: int, in_place: bool) -> dict:
        by, key = self.by.get(name), uuid.uuid4().hex
        path = f"{self.root}/{name}/{key}"
        if by is None:
            df.write.parquet(path)
        else:
            # One file a bucket; rows that were read from buckets of the same number are there already.
            dealt = df if in_place else df.repartition(buckets, by)
            dealt.write.format("parquet").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(f"memory_{key}")
        return {"path": path, "schema": df.schema.jsonValue(), "by": by, "buckets": buckets if by else 0}

    def commit(self, base: Version, tables: Mapping[str, DataFrame], batch: tuple[str, int] | None = None, in_place: Collection[str] = ()) -> Version:
        """The version after base with these tables in place of its own; its other tables stay what they are. Raises
        Conflict if another writer came first. in_place: bucketed tables that come from base row by row."""
        buckets = next((t["buckets"] for t in base.tables.values() if t["buckets"]), self.buckets)
        told = {**base.tables, **{name: self._written(name, df, buckets, name in in_place) for name, df in tables.items()}}
        new = Version(base.number + 1, told, {**base.ledger, **({batch[0]: batch[1]} if batch else {})})
        self._publish(new)
        return new

    def update(self, step: Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]], batch: tuple[str, int] | None = None, attempts: int = 5, in_place: Collection[str] = ()) -> Version:
        """What step makes of the newest version, as the next one. A batch that is in already changes nothing; where
        another writer came first, step is taken again from what that one wrote."""
        for left in reversed(range(attempts)):
            base = self.version()
            if base.has(batch):
                return base
            try:
                return self.commit(base, step(self.read(base)), batch, in_place)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def expire(self, keep: int = 2) -> None:
        """Deletes all but the newest `keep` versions, and the folders that only they name. Readers of older versions
        have to be done, and no writer may be at work."""
        numbers = self.versions()
        gone, stay = numbers[:-keep], numbers[-keep:]
        held = {t["path"] for n in stay for t in self.version(n).tables.values()}
        told = [t for n in gone for t in self.version(n).tables.values() if t["path"] not in held]
        for n in gone:
            fs, at = _hadoop(self.spark, self._manifest(n))
            fs.delete(at, False)
        for t in told:
            fs, at = _hadoop(self.spark, t["path"])
            self.spark.sql(f"DROP TABLE IF EXISTS memory_{t['path'].rsplit('/', 1)[-1]}")
            fs.delete(at, True)


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of the files at or below paths: where they are, how long, and when they were written."""
    said = []
    for path in paths:
        fs, at = _hadoop(spark, path)
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            said.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(said)).encode()).hexdigest()[:32]
