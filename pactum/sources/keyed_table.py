"""A stored table with keys: versions, readers that stay on one, and writes of touched buckets only.

Layout below the table's path: ``data/<id>/_group=<bits>/`` holds the Parquet files of one write, ``versions/<n>.json``
one manifest for each version. A manifest names the keys, the columns, and for each bucket its folder and its number
of rows. A write first puts its new folders in place and then its manifest, under the next number, by a rename that
does not overwrite. So a version is there whole or not at all, a write that dies in between leaves the table as it
was, and of two writers that began at the same version one is refused. Files of older versions stay until
``vacuum``, so that a reader of a version is never disturbed.

Small buckets share files: a write packs those whose names end in the same bits, about ``GROUP_ROWS`` rows together, and
each row says its bucket and its write. So the number of files follows the rows, not the number of buckets. A group all of
whose buckets are wanted is read as it is; of others the rows are told by a join with the names that are wanted.

A row's bucket is told by the lowest bits of the hash of its bucket columns: name ``<depth>-<bits>``. A bucket that
grows beyond ``split_rows`` is written as buckets of more bits; the others are left alone (extendible hashing).
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import delete_path, list_names, put_text, quoted, read_text

BUCKETS = 64
SPLIT_ROWS = 4_000_000
GROUP_ROWS = 1 << 18
#: Where a stored row is: the write that brought it, and its bucket.
PLACE = T.StructType([T.StructField("_write", T.StringType()), T.StructField("_bucket", T.StringType())])
LISTING, LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 64


class VersionConflict(RuntimeError):
    """Another writer has put the next version in place first."""


def _depth(buckets: int) -> int:
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("the number of buckets has to be a power of two")
    return buckets.bit_length() - 1


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Versions ------------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        names = list_names(self.spark, f"{self.path}/versions")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        return json.loads(read_text(self.spark, f"{self.path}/versions/{version}.json")) | {"version": version}

    def commit(self, manifest: dict) -> dict:
        """Put ``manifest`` in place as the version after the one it was made from."""
        after = manifest | {"version": manifest["version"] + 1}
        if not put_text(self.spark, f"{self.path}/versions/{after['version']}.json", json.dumps(after)):
            raise VersionConflict(f"{self.path} has a version {after['version']} already")
        return after

    def create(self, schema: T.StructType, keys: Sequence[str], buckets: int = BUCKETS, by: Sequence[str] | None = None, split_rows: int = SPLIT_ROWS, meta: dict | None = None) -> dict:
        """An empty first version. Rows are dealt into buckets by ``by``, the keys unless given."""
        depth = _depth(buckets)
        names = {f"{depth}-{bits}": {"folder": None, "rows": 0} for bits in range(buckets)}
        own = {"version": 0, "keys": list(keys), "by": list(by or keys), "schema": schema.json(), "first_buckets": buckets, "split_rows": split_rows}
        return self.commit(own | {"buckets": names, "meta": meta or {}})

    # Reading -------------------------------------------------------------------------------------------------------

    @staticmethod
    def schema(manifest: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(manifest["schema"]))

    def read(self, version: int | None = None, buckets: Iterable[str] | None = None, manifest: dict | None = None) -> DataFrame:
        """The rows of one version, of some of its buckets."""
        manifest = manifest or self.manifest(version)
        wanted = manifest["buckets"] if buckets is None else buckets
        places: dict[tuple[str, int | str], list[str]] = {}
        for b in wanted:
            if folder := manifest["buckets"][b]["folder"]:
                places.setdefault((folder, self._group(manifest, folder, b)), []).append(b)
        schema = self.schema(manifest)
        if not places:
            # Not createDataFrame: it starts Python workers for no rows.
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))
        whole, cut = [], []
        for (folder, group), names in sorted(places.items(), key=str):
            if isinstance(group, str):  # a table of before has a folder for each bucket
                whole.append(f"{self.path}/data/{folder}/_bucket={group}")
            else:
                all_there = len(names) == manifest["folders"][folder]["groups"][str(group)]
                (whole if all_there else cut).append(f"{self.path}/data/{folder}/_group={group}")
        parts = []
        with self._few_listing_tasks():
            if whole:
                parts.append(self.spark.read.schema(schema).parquet(*whole))
            if cut:
                own = T.StructType([*schema.fields, *PLACE.fields])
                read = self.spark.read.schema(own).parquet(*cut)
                parts.append(read.join(self._named(manifest, places), PLACE.names, "left_semi").select(*(F.col(quoted(c)) for c in schema.names)))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _named(self, manifest: dict, places: dict) -> DataFrame:
        """(_write, _bucket) of the buckets in ``places``."""
        import pyarrow as pa

        rows = [(folder, b) for (folder, _), names in places.items() for b in names]
        columns = [pa.array(c, pa.string()) for c in zip(*rows)]
        return self.spark.createDataFrame(pa.table(columns, names=PLACE.names))

    @staticmethod
    def _group(manifest: dict, folder: str, bucket: str) -> int | str:
        """The group of a write's buckets that one is stored in; for a write of before, its name."""
        stored = manifest.get("folders", {}).get(folder)
        return bucket if stored is None else int(bucket.split("-")[1]) & (1 << stored["bits"]) - 1

    @contextmanager
    def _few_listing_tasks(self) -> Iterator[None]:
        """Spark lists folders in a job with a task for each, up to 10,000: a table has many small ones."""
        before = self.spark.conf.get(LISTING)
        self.spark.conf.set(LISTING, str(min(int(before), LISTING_TASKS)))
        try:
            yield
        finally:
            self.spark.conf.set(LISTING, before)

    # Buckets -------------------------------------------------------------------------------------------------------

    @staticmethod
    def bucket(manifest: dict) -> Column:
        """The bucket of a row. Most buckets have one depth, which needs no list of names."""
        hashed = F.xxhash64(*(F.col(quoted(c)) for c in manifest["by"]))
        depths: dict[int, list[str]] = {}
        for name in manifest["buckets"]:
            depths.setdefault(int(name.split("-")[0]), []).append(name)
        common = max(depths, key=lambda d: len(depths[d]))
        named = lambda d: F.concat(F.lit(f"{d}-"), hashed.bitwiseAND(F.lit((1 << d) - 1)).cast("string"))
        out = named(common)
        for depth, names in depths.items():
            if depth != common:
                out = F.when(named(depth).isin(names), named(depth)).otherwise(out)
        return out

    # Writing -------------------------------------------------------------------------------------------------------

    def rewrite(self, manifest: dict, rows: DataFrame, touched: Iterable[str], meta: dict | None = None, once: bool = False) -> dict:
        """The next version: the ``touched`` buckets hold exactly ``rows``, which lie in them; the others stay. With
        ``once`` rows may repeat a key, and one of them is kept; that is told apart in the tasks that write."""
        touched = set(touched)
        after, folders = dict(manifest["buckets"]), dict(manifest.get("folders", {}))
        columns = [F.col(quoted(f.name)) for f in self.schema(manifest).fields]
        if touched:
            placed = rows.select(*columns, self.bucket(manifest).alias("_bucket"))
            sizes = {r["_bucket"]: r["n"] for r in placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a bucket
            if wrong := set(sizes) - touched:
                raise ValueError(f"rows of buckets that are not rewritten: {sorted(wrong)[:3]}")
            grown: dict[int, list[str]] = {}
            for name in touched:
                del after[name]
                depth, bits = map(int, name.split("-"))
                more = max(0, math.ceil(math.log2(max(sizes.get(name, 0), 1) / manifest["split_rows"])))
                grown.setdefault(depth + more, []).append(name)
                for high in range(1 << more):
                    after[f"{depth + more}-{bits + (high << depth)}"] = {"folder": None, "rows": 0}
            hashed = F.xxhash64(*(F.col(quoted(c)) for c in manifest["by"]))
            target = F.col("_bucket")
            for depth, names in grown.items():
                if split := [n for n in names if int(n.split("-")[0]) < depth]:
                    name = F.concat(F.lit(f"{depth}-"), hashed.bitwiseAND(F.lit((1 << depth) - 1)).cast("string"))
                    target = name if len(split) == len(touched) else F.when(F.col("_bucket").isin(split), name).otherwise(target)
            folder = uuid.uuid4().hex
            bits = max(0, math.ceil(math.log2(max(sum(sizes.values()), 1) / GROUP_ROWS)))
            group = F.substring_index("_bucket", "-", -1).cast("long").bitwiseAND(F.lit((1 << bits) - 1))
            dealt = placed.withColumn("_bucket", target).withColumn("_write", F.lit(folder)).withColumn("_group", group).repartition("_group")
            dealt = dealt.dropDuplicates([*reversed(manifest["keys"]), "_bucket", "_group"]) if once else dealt
            write = dealt.sortWithinPartitions("_group", "_bucket").write.partitionBy("_group").option("compression", "zstd")
            # Tasks put their files in place, not the driver one by one: no reader knows the folder before its manifest.
            write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.path}/data/{folder}")
            with self._few_listing_tasks():
                stored = self.spark.read.schema("_bucket string").parquet(f"{self.path}/data/{folder}")
            groups: dict[str, int] = {}
            folders[folder] = {"bits": bits, "groups": groups}
            for r in stored.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect():
                after[r["_bucket"]] = {"folder": folder, "rows": r["n"]}
                own = str(self._group({"folders": folders}, folder, r["_bucket"]))
                groups[own] = groups.get(own, 0) + 1
        live = {b["folder"] for b in after.values()}
        folders = {f: x for f, x in folders.items() if f in live}
        return self.commit(manifest | {"buckets": after, "folders": folders, "meta": manifest["meta"] if meta is None else meta})

    def rebucket(self, buckets: int) -> dict:
        """The next version, with the same rows in another number of buckets."""
        old = self.manifest()
        depth = _depth(buckets)
        names = {f"{depth}-{bits}": {"folder": None, "rows": 0} for bits in range(buckets)}
        return self.rewrite(old | {"buckets": names, "first_buckets": buckets}, self.read(manifest=old), names)

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the ``keep`` newest versions, and delete the folders that none of those has. Folders of a
        write under way are not known yet, so the caller holds off writers. Returns the number of deleted folders."""
        versions = self.versions()
        live = {b["folder"] for v in versions[-keep:] for b in self.manifest(v)["buckets"].values()}
        for v in versions[:-keep]:
            delete_path(self.spark, f"{self.path}/versions/{v}.json")
        gone = [f for f in list_names(self.spark, f"{self.path}/data") if f not in live]
        for folder in gone:
            delete_path(self.spark, f"{self.path}/data/{folder}")
        return len(gone)
