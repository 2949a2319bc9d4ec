"""Upserts, replacements and deletions on tables of files, and versions of tables that readers never see half written."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.session import broadcast_small

#: Columns of which a later NULL doesn't replace an earlier value, and those of which the first write holds.
KEEP_LAST_KNOWN = ("published_date", "title")
KEEP_FIRST = ("domain", "file_path")


def upsert_scans(existing: DataFrame, new: DataFrame, key: str = "url", order: str = "scanned_at") -> DataFrame:
    """One row per url: the newest values, the last known date and title, the first domain and path. Rows without url are all kept.

    One aggregation by url; of equal times the row with the greater values in order of columns counts as newer. Rows with a NULL time come before all
    others.
    """
    both = existing.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    named = both.filter(F.col(key).isNotNull())
    plain = [c for c in rest if c not in KEEP_LAST_KNOWN and c not in KEEP_FIRST]
    newest = F.max(F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"), *(F.col(c) for c in plain))).alias("newest")
    kept = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("at"), F.col(c).alias("v"))))["v"].alias(c) for c in KEEP_LAST_KNOWN if c in rest]
    first = [F.min(F.struct(F.col(order).alias("at"), F.col(c).alias("v")))["v"].alias(c) for c in KEEP_FIRST if c in rest]
    merged = named.groupBy(key).agg(newest, *kept, *first)
    cols = [F.col(key), *(F.col(c) if c in KEEP_LAST_KNOWN or c in KEEP_FIRST else F.col("newest")[c].alias(c) for c in rest)]
    out = merged.select(*cols)
    return out.unionByName(both.filter(F.col(key).isNull()).select(key, *rest)).select(*both.columns)


def replace_children(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing without the rows of keys that new has, and new. A NULL key replaces nothing."""
    kept = existing.join(new.select(key).distinct(), key, "left_anti").select(*existing.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def delete_domain(scans: DataFrame, children: DataFrame, domain: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a domain's scans. Scans of a NULL domain stay."""
    gone = scans.filter(F.col("domain") == domain).select(F.col("id").alias("scan_id")).distinct()
    return scans.filter(~F.col("domain").eqNullSafe(domain)), children.join(gone, "scan_id", "left_anti").select(*children.columns)


def delete_excluded(scans: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scans of other domains, and per excluded domain how many were deleted."""
    out = broadcast_small(excluded.select("domain").distinct())
    return scans.join(out, "domain", "left_anti").select(*scans.columns), scans.join(out, "domain", "left_semi").groupBy("domain").agg(F.count(F.lit(1)).alias("deleted"))


class VersionedTable:
    """A table as a log of versions. A version is a small file that names, for each bucket of a key's hash, the folders which hold it.

    A writer writes new folders first and then the version's file, under another name that is renamed: the rename is the commit. Readers take the highest version there
    is, so that they find the old table or the new one and never less; a writer that dies leaves folders that no version names. A merge writes
    the buckets that its rows fall into and takes all others over by name. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2, buckets: int = 64):
        self.spark, self.path, self.keep, self.buckets = spark, path.rstrip("/"), keep, buckets
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Names of the versions that were committed, oldest first."""
        if not self._fs.exists(self._p(self.path)):
            return []
        return sorted(n for s in self._fs.listStatus(self._p(self.path)) if (n := s.getPath().getName()).startswith("version-"))

    def _manifest(self, version: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{version}").first()[0])  # one line

    def current(self) -> dict | None:
        """The newest version: batch (id of the last batch merged, or None) and folders (bucket -> names)."""
        found = self.versions()
        return self._manifest(found[-1]) if found else None

    def _folders(self, names: list[str], schema=None) -> DataFrame:
        read = self.spark.read.option("mergeSchema", "true") if schema is None else self.spark.read.schema(schema)
        return read.parquet(*(f"{self.path}/{n}" for n in names))

    def read(self, schema=None) -> DataFrame:
        """The newest version. A table that never had one is empty if its schema is given; columns of the schema that older files lack are NULL."""
        at = self.current()
        names = sorted({n for own in at["folders"].values() for n in own}) if at else []
        if names:
            return self._folders(names, schema)
        if schema is None:
            raise FileNotFoundError(self.path)
        return self.spark.createDataFrame([], schema)

    def _put(self, df: DataFrame, key: str | None) -> dict[str, list[str]]:
        """Writes rows into new folders, one for each bucket that has any."""
        at = f"data-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        if key is None:
            df.write.parquet(f"{self.path}/{at}/all")
            return {"all": [f"{at}/all"]}
        df.withColumn("__bucket", self._bucket(key)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{at}")
        found = (s.getPath().getName() for s in self._fs.listStatus(self._p(f"{self.path}/{at}")))
        return {n.partition("=")[2]: [f"{at}/{n}"] for n in found if n.startswith("__bucket=")}

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("string")

    def _commit(self, folders: dict[str, list[str]], batch: int | None) -> None:
        name = f"version-{time.time_ns():020d}"
        fresh = self._p(f"{self.path}/_{name}")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(json.dumps({"batch": batch, "folders": folders}).encode()))
        stream.close()
        if not self._fs.rename(fresh, self._p(f"{self.path}/{name}")):
            raise OSError(f"{self.path}: the version could not be committed")
        self._clean()

    def _clean(self) -> None:
        """Removes old versions, and the folders that none of those kept names."""
        found = self.versions()
        for v in found[: -self.keep]:
            self._fs.delete(self._p(f"{self.path}/{v}"), False)
        used = {n for v in found[-self.keep :] for own in self._manifest(v)["folders"].values() for n in own}
        for s in self._fs.listStatus(self._p(self.path)):
            at = s.getPath().getName()
            if at.startswith("data-") and at < found[-1].replace("version-", "data-"):
                inside = [x.getPath().getName() for x in self._fs.listStatus(s.getPath()) if not x.getPath().getName().startswith(("_SUCCESS", "."))]
                gone = [x for x in inside if f"{at}/{x}" not in used]
                for x in gone if len(gone) < len(inside) else [None]:
                    self._fs.delete(self._p(f"{self.path}/{at}/{x}" if x else f"{self.path}/{at}"), True)

    def write(self, df: DataFrame, key: str | None = None) -> None:
        """Replaces the whole table, laid out in buckets of a key if one is named."""
        self._commit(self._put(df, key), None)

    def merge(self, new: DataFrame, key: str, combine, schema, batch: int | None = None) -> bool:
        """Replaces the rows of the buckets that new falls into by combine(rows there, new). A batch whose number is not above that of the last one changes nothing; then False.

        new is read twice and should be a table. combine must not move rows to other keys.
        """
        at = self.current() or {"batch": None, "folders": {}}
        if batch is not None and at["batch"] is not None and batch <= at["batch"]:
            return False
        folders = at["folders"]
        if "all" in folders:
            folders = self._put(self._folders(folders["all"], schema), key)
        touched = [r[0] for r in new.select(self._bucket(key)).distinct().collect()]  # no more than there are buckets
        names = sorted({n for b in touched for n in folders.get(b, [])})
        old = self._folders(names, schema) if names else self.spark.createDataFrame([], schema)
        fresh = self._put(combine(old, new), key) if touched else {}
        self._commit({**{b: own for b, own in folders.items() if b not in touched}, **fresh}, at["batch"] if batch is None else batch)
        return True
