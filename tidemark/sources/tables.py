"""Tables in a shared folder, published by manifests.

A table is cut into parts (a month, a bucket of a key's hash), and a manifest lists the folders that make up each part of each table.
Data is written first, under a folder of its own that nobody reads; then the manifest of the next number is put in
place by a rename that fails where the number exists. So several tables change at once or not at all, a lost driver
leaves the old state, two writers cannot both succeed, and readers keep what they have begun to read.

Reading names the parts, so files of others are not even listed. Of parts that grow, every FAN folders of one level are merged
into one of the next level, in the same publication as the change: a part has at most (FAN - 1) folders a level and
levels grow with the logarithm of the publications, as does how often a row is rewritten. `vacuum` removes what no recent
manifest names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FAN = 4
PART = "part"


def month_part(day: Column) -> Column:
    """The month of a date or time, as the name of a part."""
    return F.date_format(day, "yyyy-MM")


def bucket_part(key: Column, buckets: int) -> Column:
    return F.concat(F.lit("b"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string"))


class Conflict(RuntimeError):
    """Another writer has published since the manifest was read."""


@dataclass(frozen=True)
class Manifest:
    number: int = -1
    parts: dict[str, dict[str, list[str]]] = field(default_factory=dict)   # table -> part -> folders
    schemas: dict[str, str] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)                     # writer -> its last batch
    settings: dict[str, int] = field(default_factory=dict)                 # fixed by the first publication

    def folders(self, table: str, parts: list[str] | None = None) -> list[str]:
        own = self.parts.get(table, {})
        return [f for p in sorted(own if parts is None else set(parts) & own.keys()) for f in own[p]]


class TableStore:
    """`folders`: where each table lies below `home` (its name, unless given)."""

    def __init__(self, spark: SparkSession, home: str, folders: dict[str, str] | None = None) -> None:
        self.spark, self.home, self.places = spark, home.rstrip("/"), folders or {}
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.home).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests

    def _manifests(self) -> list[str]:
        found = self._fs.globStatus(self._hadoop.Path(f"{self.home}/_manifests/*.json"))
        return sorted(f.getPath().getName() for f in found or ())

    def manifest(self) -> Manifest:
        """The newest state; an empty one where nothing was published."""
        names = self._manifests()
        return self._read(names[-1]) if names else Manifest()

    def _read(self, name: str) -> Manifest:
        text = self.spark.read.text(f"{self.home}/_manifests/{name}", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def _put(self, manifest: Manifest) -> None:
        place = self._hadoop.Path(f"{self.home}/_manifests/{manifest.number:012d}.json")
        draft = self._hadoop.Path(f"{self.home}/_manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(vars(manifest)).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
        kind = getattr(self._hadoop, "Options$Rename")
        try:
            context.rename(draft, place, self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception as exc:
            self._fs.delete(draft, False)
            if self._fs.exists(place):
                raise Conflict(f"manifest {manifest.number} is there already") from exc
            raise

    # -- data

    def read(self, table: str, schema: StructType | None = None, parts: list[str] | None = None,
             manifest: Manifest | None = None) -> DataFrame:
        """The rows of the parts (of all, if None)."""
        now = manifest or self.manifest()
        schema = schema or StructType.fromJson(json.loads(now.schemas[table]))
        folders = [f"{self.home}/{f}" for f in now.folders(table, parts)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def write(self, table: str, rows: DataFrame, level: int = 0) -> dict[str, list[str]]:
        """Writes rows (with a column `part`) where nobody reads yet; part -> folders. A part that is much larger than others
        is split over tasks."""
        place = "/".join(filter(None, [self.places.get(table, table), f"write={level}-{uuid.uuid4().hex}"]))
        rows.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.home}/{place}")
        found = self._fs.globStatus(self._hadoop.Path(f"{self.home}/{place}/{PART}=*"))
        return {n.removeprefix(f"{PART}="): [f"{place}/{n}"] for n in sorted(f.getPath().getName() for f in found or ())}

    def publish(self, base: Manifest, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None,
                emptied: dict[str, list[str]] | None = None, done: dict[str, int] | None = None,
                settings: dict[str, int] | None = None) -> Manifest:
        """One new state on top of `base`: parts in `replace` are exchanged, those in `append` get further rows, `emptied` are
        parts that `replace` leaves without rows. Raises Conflict if somebody else was faster; nothing has changed then."""
        parts = {t: dict(p) for t, p in base.parts.items()}
        schemas = dict(base.schemas)
        for table, names in (emptied or {}).items():
            for part in names:
                parts.get(table, {}).pop(part, None)
        for change, grows in ((replace, False), (append, True)):
            for table, rows in (change or {}).items():
                schemas.setdefault(table, rows.drop(PART).schema.json())
                own = parts.setdefault(table, {})
                for part, folders in self.write(table, rows).items():
                    own[part] = own.get(part, []) + folders if grows else folders
        for table in append or {}:
            self._merge(table, parts[table], StructType.fromJson(json.loads(schemas[table])))
        now = Manifest(base.number + 1, parts, schemas, base.done | (done or {}), (settings or {}) | base.settings)
        self._put(now)
        return now

    def _merge(self, table: str, parts: dict[str, list[str]], schema: StructType) -> None:
        """Merges every FAN folders of one level, of all parts in one write a level."""
        level = 0
        while level <= max((_level(f) for own in parts.values() for f in own), default=-1):
            full = {p: same for p, own in parts.items() if len(same := [f for f in own if _level(f) == level]) >= FAN}
            if full:
                rows = self.spark.read.schema(schema).parquet(*[f"{self.home}/{f}" for same in full.values() for f in same])
                rows = rows.withColumn(PART, F.regexp_extract("_metadata.file_path", f"/{PART}=([^/]*)/", 1))
                for part, folders in self.write(table, rows, level + 1).items():
                    parts[part] = [f for f in parts[part] if f not in full[part]] + folders
            level += 1

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the newest `keep` manifests and the folders that these do not name; how many folders went. Not to
        be run while someone is writing."""
        names = self._manifests()
        used = {f for name in names[-keep:] for table in self._read(name).parts.values() for own in table.values() for f in own}
        tables = {t for name in names for t in self._read(name).parts}
        gone = 0
        for table in tables:
            place = "/".join(filter(None, [self.places.get(table, table), "write=*", f"{PART}=*"]))
            for status in self._fs.globStatus(self._hadoop.Path(f"{self.home}/{place}")) or ():
                path = status.getPath()
                relative = "/".join(filter(None, [self.places.get(table, table), path.getParent().getName(), path.getName()]))
                if relative not in used:
                    self._fs.delete(path, True)
                    gone += 1
        for name in names[:-keep]:
            self._fs.delete(self._hadoop.Path(f"{self.home}/_manifests/{name}"), False)
        return gone


def _level(folder: str) -> int:
    return int(folder.rsplit("write=", 1)[1].split("-", 1)[0])


def touched_parts(rows: DataFrame, part: Column) -> list[str]:
    """Names of the parts that rows fall into: as many as there are months or buckets."""
    return sorted(r[0] for r in rows.select(part.alias(PART)).where(F.col(PART).isNotNull()).distinct().collect())
