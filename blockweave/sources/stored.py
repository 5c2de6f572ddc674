"""Tables that are replaced at once, in whole or in part, and manifests that join without a shuffle."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "current.json"
PARTS = 64


class StoredTable:
    """A table in parts by a hash of ``by``, in a folder on storage that all executors share.

    What is current is said by one small file, which a rename replaces after all
    data is written: a reader sees the table before or after a change, and a write
    that fails changes nothing. A change writes only parts that hold rows of the
    keys it is about; other parts keep their files. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, by: str = "volume_id", parts: int = PARTS):
        self.spark, self.path, self.by, self.parts = spark, path.rstrip("/"), by, parts

    def _store(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def current(self) -> dict | None:
        """The schema, and of each part the folder that holds it; null where nothing is stored."""
        store = self._store()
        if not store.exists(self._at(POINTER)):
            return None
        got = self.spark.read.text(f"{self.path}/{POINTER}", wholetext=True).head()
        said = json.loads(got[0])
        if (said["by"], said["parts"]) != (self.by, self.parts):
            raise ValueError(f"the table is kept by {said['by']} in {said['parts']} parts")
        return said

    def _switch(self, schema: T.StructType, folders: dict[str, str]) -> None:
        """Write the new pointer beside the old one and rename it over that."""
        jvm, store, fresh = self.spark._jvm, self._store(), self._at(f"{POINTER}-{uuid.uuid4().hex}")
        out = store.create(fresh, True)
        out.write(json.dumps({"by": self.by, "parts": self.parts, "schema": schema.json(), "folders": folders}).encode())
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, self._at(POINTER), how)

    def _read(self, said: dict, parts: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(said["schema"]))
        folders = [f"{self.path}/{f}/part_={p}" for p, f in said["folders"].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        said = self.current()
        if said is None:
            raise ValueError(f"nothing is stored at {self.path}")
        return self._read(said)

    def _write(self, df: DataFrame) -> dict[str, str]:
        """(part: folder) of df's rows, written into a folder of their own; a large part by several tasks."""
        folder = uuid.uuid4().hex
        df.withColumn("part_", self.part(F.col(self.by))).write.partitionBy("part_").parquet(f"{self.path}/{folder}")
        written = [s.getPath().getName() for s in self._store().listStatus(self._at(folder))]
        return {n.split("=")[1]: folder for n in written if n.startswith("part_=")}

    def replace(self, df: DataFrame) -> None:
        """The whole table anew; df may read the table itself."""
        self._switch(df.schema, self._write(df))

    def update(self, df: DataFrame, keys: DataFrame) -> None:
        """All rows of the keys (by) replaced by df's rows of them; keys without rows in df go. Only parts that a key falls into are written."""
        said = self.current()
        if said is None:
            raise ValueError(f"nothing is stored at {self.path}")
        wanted = keys.select(F.col(self.by).alias("k_")).distinct()
        parts = [r[0] for r in wanted.select(self.part(F.col("k_")).alias("p")).distinct().collect()]  # so many at most as the table has parts
        old = self._read(said, parts)
        same = lambda d: d[self.by].eqNullSafe(wanted["k_"])
        kept = old.join(wanted, same(old), "left_anti")
        new = self._write(kept.unionByName(df.join(wanted, same(df), "left_semi").select(*old.columns)))
        self._switch(old.schema, {p: f for p, f in said["folders"].items() if int(p) not in parts} | new)

    def vacuum(self) -> int:
        """Delete folders that the pointer doesn't name; how many. For a time when nobody reads an older state."""
        said, store, n = self.current(), self._store(), 0
        live = set(said["folders"].values()) if said else set()
        for s in store.listStatus(self._at("")) if store.exists(self._at("")) else []:
            name = s.getPath().getName()
            if name != POINTER and name not in live:
                n += bool(store.delete(s.getPath(), True))
        return n


def regenerated(table: StoredTable, actual: DataFrame, why: DataFrame) -> None:
    """The stored entries with those of the volumes to be rebuilt (volume_id) replaced by the actual ones, in place: parts without such volumes keep their files."""
    table.update(actual, why)


def save_bucketed(df: DataFrame, name: str, path: str, by: list[str], buckets: int) -> None:
    """A catalog table in buckets by its join keys, each sorted: joins and aggregates by these keys read it without a shuffle."""
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", path).format("parquet").saveAsTable(name)
