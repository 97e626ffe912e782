"""Copies that differ in formatting only: canonical keys and an incremental ledger of their counts.

A record's key is a 128-bit hash of its fields with white space, invisible characters, letter case, punctuation and other
signs, Unicode composition and the order of fields in JSON objects left aside; where one value of a JSON text ends and the
next begins is part of the key. The ledger is a table of (key, number of copies, earliest record) in buckets of about
KEYS_A_BUCKET keys. A batch is aggregated by key (partly before the shuffle, so a key that holds a third of the rows is no
burden), full-outer-joined to those buckets that its keys fall into, and these alone are written anew; the other buckets'
files stay as they are. A list of buckets, written last, says which files count. Rows seen before are never read again. When
the keys have outgrown their buckets, the next batch splits each in two.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Collection, Iterator, Sequence
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import runtime
from tidemill.functions.normalize import folded, squashed
from tidemill.runtime import join_counted, new_path, spread, written

#: Keys that a bucket is to hold about, and the fewest buckets.
KEYS_A_BUCKET, LEAST_BUCKETS = 500_000, 8
_NAMES: dict[str, str] = {}


def _name(key: str) -> str:
    if key not in _NAMES:
        if len(_NAMES) > 100_000:
            _NAMES.clear()
        _NAMES[key] = squashed(key)
    return _NAMES[key]


class _Object:
    """A JSON object's fields as they stand."""

    __slots__ = ("pairs",)

    def __init__(self, pairs: list[tuple[str, object]]) -> None:
        self.pairs = pairs

    def in_order(self) -> list[tuple[str, object]]:
        """By name; equal names stay in the order given."""
        return sorted(((_name(k), v) for k, v in self.pairs), key=lambda p: p[0])


_DECODE = json.JSONDecoder(object_pairs_hook=_Object, parse_float=str, parse_int=str, parse_constant=str).decode


def _plain(value: object) -> str:
    """A JSON value without formatting: plain values squashed, with signs that squashed text never has where values begin and end."""
    if type(value) is str:
        return squashed(value)
    if type(value) is _Object:
        return "{" + ",".join([f"{k}:{_plain(v)}" for k, v in value.in_order()]) + "}"
    if type(value) is list:
        return "[" + ",".join(map(_plain, value)) + "]"
    return {None: "null", True: "true", False: "false"}[value]


def canonical_json(text: str) -> str:
    """JSON text without formatting and field order; other text squashed. Signs and points of numbers are left aside like all
    others, but not the bounds between values. JSON nested too deep for the parser is squashed as text."""
    value: object = folded(text)
    try:
        while isinstance(value, str) and value.lstrip()[:1] in ("[", "{", '"'):
            value = _DECODE(value)
        return _plain(value)
    except (ValueError, RecursionError):
        return squashed(value if isinstance(value, str) else text)


def canonical_key(plain: Sequence[str | None], as_json: Sequence[str | None]) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for text, fold in [(x, squashed) for x in plain] + [(x, canonical_json) for x in as_json]:
        h.update(b"\0N" if text is None else b"\0T" + fold(text).encode("utf-8", "surrogatepass"))
    return h.digest()


def canonical_keys(rows: DataFrame, id_col: str, plain: list[str], as_json: list[str]) -> DataFrame:
    """(id, key_hi, key_lo) of every row. Null agrees with null only; empty and blank agree with one another."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(1, b.num_columns)]
            digests = [canonical_key(row[: len(plain)], row[len(plain) :]) for row in zip(*columns, strict=True)]
            halves = [pa.array([int.from_bytes(d[at : at + 8], "big", signed=True) for d in digests], pa.int64()) for at in (0, 8)]
            yield pa.RecordBatch.from_arrays([b.column(0), *halves], names=["id", "key_hi", "key_lo"])

    narrow = rows.select(F.col(id_col).cast("bigint").alias("id"), *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate([*plain, *as_json])))
    return spread(narrow).mapInArrow(keys, "id bigint, key_hi bigint, key_lo bigint")


@dataclasses.dataclass(frozen=True)
class Ledger:
    """Counts of canonical keys over all batches so far: a folder with the files of each bucket in the version that wrote it."""

    spark: SparkSession
    buckets: int | None = None
    path: str | None = None
    versions: dict[int, int] = dataclasses.field(default_factory=dict)
    version: int = 0
    keys: int = 0

    SCHEMA: ClassVar[str] = "key_hi bigint, key_lo bigint, copies bigint, first_id bigint, bucket int"

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> Ledger:
        """A ledger that was written before, as its list of buckets says."""
        at = json.loads(runtime.read_text(spark, f"{path}/buckets.json"))
        return cls(spark, at["buckets"], path, {int(b): v for b, v in at["versions"].items()}, at["version"], at["keys"])

    def _files(self, bucket: int) -> str:
        return f"{self.path}/version={self.versions[bucket]}/bucket={bucket}"

    def table(self, only: Collection[int] | None = None) -> DataFrame:
        """All keys, or those of some buckets."""
        paths = [self._files(b) for b in sorted(self.versions) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(*paths).select("key_hi", "key_lo", "copies", "first_id", "bucket")

    def add(self, keyed: DataFrame) -> Ledger:
        """The ledger with a batch of (id, key_hi, key_lo) added. The earliest representative is the one with the least id."""
        new = written(keyed.groupBy("key_hi", "key_lo").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), "batch")
        most = self.keys + new.count()
        buckets = self.buckets or max(LEAST_BUCKETS, 1 << (most // KEYS_A_BUCKET).bit_length())
        split = self.buckets is not None and self.keys > 2 * KEYS_A_BUCKET * buckets
        if split:
            buckets *= 2
        new = new.withColumn("bucket", F.pmod("key_hi", F.lit(buckets)).cast("int"))
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # one number a bucket
        old = self.table(None if split else touched).withColumn("bucket", F.pmod("key_hi", F.lit(buckets)).cast("int"))
        merged = old.join(new, ["bucket", "key_hi", "key_lo"], "full_outer").select(
            "key_hi", "key_lo",
            (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"),
            F.least("first_id", "least").alias("first_id"),
            "bucket",
        )
        path, version = self.path or new_path(self.spark, "ledger"), self.version + 1
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/version={version}")
        rewritten = {int(name.removeprefix("bucket=")) for name, _, is_dir, _ in runtime.listing(self.spark, f"{path}/version={version}") if is_dir}
        kept = {} if split else {b: v for b, v in self.versions.items() if b not in rewritten}
        after = Ledger(self.spark, buckets, path, kept | dict.fromkeys(rewritten, version), version, 0)
        after = dataclasses.replace(after, keys=self.keys + self.spark.read.schema(self.SCHEMA).parquet(f"{path}/version={version}").count() - (old.count() if touched or split else 0))
        runtime.write_text(self.spark, f"{path}/buckets.json", json.dumps({"buckets": after.buckets, "version": version, "keys": after.keys, "versions": after.versions}))
        return after

    def forget_old(self) -> None:
        """Removes files of buckets that later versions replaced. Ledgers from before can't be read any more."""
        for name, _, is_dir, _ in runtime.listing(self.spark, self.path) if self.path else ():
            if not (is_dir and name.startswith("version=")):
                continue
            version = int(name.removeprefix("version="))
            if version not in self.versions.values():
                runtime.delete(self.spark, f"{self.path}/{name}")
                continue
            for part, _, _, _ in runtime.listing(self.spark, f"{self.path}/{name}"):
                if part.startswith("bucket=") and self.versions.get(int(part.removeprefix("bucket="))) != version:
                    runtime.delete(self.spark, f"{self.path}/{name}/{part}")


def collapse(batches: Sequence[DataFrame], id_col: str, plain: list[str], as_json: list[str], buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs batches through a new ledger. Gives the ledger's table and the keyed rows (id, key_hi, key_lo) of all batches.

    Any number of batches in any order gives the same result. Null ids count as copies but are never the representative
    unless all are null. Columns beyond those named are left out, whatever their names. No batches or empty ones give none.
    """
    spark = batches[0].sparkSession
    ledger, keyed = Ledger(spark, buckets), []
    for batch in batches:
        keyed.append(written(canonical_keys(batch, id_col, plain, as_json), "keys"))
        ledger = ledger.add(keyed[-1])
        ledger.forget_old()
    rows = keyed[0]
    for more in keyed[1:]:
        rows = rows.unionByName(more)
    return ledger.table(), rows


def copies(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """(first_id, copy_id): every row that isn't its record's representative, with the representative."""
    repeated = ledger.where("copies > 1").select("key_hi", "key_lo", "first_id", "copies")
    total = rows.count()
    return join_counted(rows, repeated, ["key_hi", "key_lo"], "copies", total).where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
