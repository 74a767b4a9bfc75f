"""A stored vault: sealed mappings with a life time in immutable files, switched by snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.crypto import seal, unseal
from maskwright.operators import tokens, vault
from maskwright.sources.shared import kept

RECORD = "scope_digest string, token_digest string, expires_at timestamp, sealed binary"
PARTS = 64


class Conflict(Exception):
    """Another writer has committed since this one read."""


class VaultStore:
    """Mappings (scope, token) -> original below a folder that all executors share.

    ``data/<id>/part=k`` holds sealed records, ``snapshots/<version>.json``
    names the directories that make up a version, one or none for each part.
    Files are never changed: a writer reads a version, writes the parts that
    it touches anew, then puts the next version's manifest in its place by a
    rename that fails where one is there already. So a writer that dies leaves
    the version before, readers keep theirs, and of two writers one wins; the
    other gets ``Conflict`` and may begin again. Parts are told by a hash of scope
    and token, so a scope that a third of all mappings share is spread over all.
    """

    def __init__(self, spark: SparkSession, path: str, key: bytes, ttl_seconds: int, parts: int = PARTS) -> None:
        if ttl_seconds <= 0:
            raise ValueError("invalid ttl")
        self.spark, self.path, self.key, self.ttl, self.parts = spark, path.rstrip("/"), key, ttl_seconds, parts

    # --- snapshots

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        return there, there.getFileSystem(self.spark._jsc.sc().hadoopConfiguration())

    def versions(self) -> list[int]:
        """The committed versions."""
        there, fs = self._hadoop(f"{self.path}/snapshots")
        names = [x.getPath().getName() for x in fs.listStatus(there)] if fs.exists(there) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, version: int) -> dict[str, str]:
        if version == 0:
            return {}
        there, fs = self._hadoop(f"{self.path}/snapshots/{version:012d}.json")
        stream = fs.open(there)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, base: int, changed: dict[str, str | None]) -> int:
        """Version ``base`` + 1, with the directories of some parts changed."""
        parts = {k: v for k, v in (self._manifest(base) | changed).items() if v is not None}
        draft, fs = self._hadoop(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        out.close()
        final, _ = self._hadoop(f"{self.path}/snapshots/{base + 1:012d}.json")
        fs.mkdirs(final.getParent())
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.sc().hadoopConfiguration())
        try:
            context.rename(draft, final, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if not fs.exists(final):
                raise
            fs.delete(draft, False)
            raise Conflict(f"version {base + 1} is there already") from e
        return base + 1

    def _latest(self) -> int:
        return max(self.versions(), default=0)

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the last versions, and the data that none of these names; no writer may be at work."""
        kept_versions = self.versions()[-keep:]
        named = {v.split("/")[1] for n in kept_versions for v in self._manifest(n).values()}
        for n in self.versions()[:-keep]:
            there, fs = self._hadoop(f"{self.path}/snapshots/{n:012d}.json")
            fs.delete(there, False)
        there, fs = self._hadoop(f"{self.path}/data")
        for x in fs.listStatus(there) if fs.exists(there) else ():
            if x.getPath().getName() not in named:
                fs.delete(x.getPath(), True)

    # --- records

    def records(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """The sealed records of a version (of the last one, without a number), or of some of its parts."""
        found = self._manifest(self._latest() if version is None else version)
        paths = [f"{self.path}/{v}" for k, v in sorted(found.items()) if parts is None or k in parts]
        return self.spark.read.schema(RECORD).parquet(*paths) if paths else self.spark.createDataFrame([], RECORD)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("scope_digest", "token_digest"), F.lit(self.parts)).cast("int")

    def _bound(self) -> Column:
        """What a record is sealed with: moved to another key or given a longer life, it does not open."""
        return F.concat_ws("|", "scope_digest", "token_digest", F.unix_micros("expires_at").cast("string"))

    def _write(self, base: int, records: DataFrame, touched: list[str]) -> int:
        place = f"data/{uuid.uuid4().hex}"
        records.withColumn("part", self._part()).repartition(self.parts, "part").write.partitionBy("part").parquet(f"{self.path}/{place}")
        there, fs = self._hadoop(f"{self.path}/{place}")
        filled = {x.getPath().getName().removeprefix("part=") for x in fs.listStatus(there) if x.isDirectory()}
        return self._commit(base, {k: f"{place}/part={k}" if k in filled else None for k in touched})

    def _touched(self, rows: DataFrame) -> list[str]:
        """The numbers of the parts that rows lie in: ``parts`` at most."""
        return sorted(str(r[0]) for r in rows.select(self._part()).distinct().collect())

    def save(self, requests: DataFrame, base: int | None = None) -> DataFrame:
        """Save requests (scope, token, original, at, ...) in order, as ``vault.save`` does, on top of what is stored; only parts with requests are rewritten. Gives the requests with their outcome, after the commit. ``base``: the version that the caller has read, if any."""
        base = self._latest() if base is None else base
        asked = kept(requests.withColumns({"scope_digest": F.when(F.col("scope") != "", F.sha2("scope", 256)), "token_digest": F.when(F.col("token") != "", F.sha2("token", 256))}), "saves")
        sound = asked.where("scope_digest IS NOT NULL AND token_digest IS NOT NULL")
        touched = self._touched(sound)
        held = self.records(base, touched).withColumn("original", unseal(F.col("sealed"), self.key, self._bound()))
        life = F.make_dt_interval(secs=F.lit(self.ttl))
        past = held.select(F.col("scope_digest").alias("scope"), F.col("token_digest").alias("token"), "original", (F.col("expires_at") - life).alias("at"), F.lit(True).alias("_stored"))
        rest = [c for c in requests.columns if c not in ("scope", "token", "original", "at")]
        new = asked.select(F.col("scope_digest").alias("scope"), F.col("token_digest").alias("token"), "original", F.col("at").cast("timestamp").alias("at"), F.struct("scope", "token", *rest).alias("_asked"))
        done = kept(vault.save(past.unionByName(new, allowMissingColumns=True), self.ttl), "outcomes")
        latest = done.where("first_at IS NOT NULL").groupBy("scope", "token").agg(F.max_by("stored", "first_at").alias("original"), F.max("first_at").alias("first_at"))
        records = latest.select(F.col("scope").alias("scope_digest"), F.col("token").alias("token_digest"), (F.col("first_at") + life).cast("timestamp").alias("expires_at"), "original")
        self._write(base, records.select("scope_digest", "token_digest", "expires_at", seal(F.col("original"), self.key, self._bound()).alias("sealed")), touched)
        return done.where("_stored IS NULL").select("_asked.*", "original", "at", "outcome")

    def resolve(self, requests: DataFrame, version: int | None = None) -> DataFrame:
        """``requests`` (scope, token, at) with ``original`` and ``error``: not_found (also when expired at that time), or corrupted where a record does not open."""
        asked = requests.withColumns({"scope_digest": F.sha2("scope", 256), "token_digest": F.sha2("token", 256)})
        found = asked.join(self.records(version), ["scope_digest", "token_digest"], "left")
        live = F.coalesce(F.col("expires_at") > F.col("at").cast("timestamp"), F.lit(False))
        found = found.withColumn("original", F.when(live, unseal(F.col("sealed"), self.key, self._bound())))
        return found.withColumn("error", F.when(~live, "not_found").when(F.col("original").isNull(), "corrupted")).drop("scope_digest", "token_digest", "sealed", "expires_at")

    def _without(self, gone: Column, base: int, joined: DataFrame) -> int:
        touched = self._touched(joined.where(gone))
        if not touched:
            return base
        stays = joined.where(~gone & self._part().cast("string").isin(touched))
        return self._write(base, stays.select("scope_digest", "token_digest", "expires_at", "sealed"), touched)

    def revoke(self, scopes: DataFrame) -> int:
        """The version without the mappings of some scopes; parts without any stay as they are, and so does the version if there is none."""
        base = self._latest()
        named = scopes.where("scope <> ''").select(F.sha2("scope", 256).alias("scope_digest")).distinct().withColumn("_gone", F.lit(True))
        return self._without(F.coalesce("_gone", F.lit(False)), base, self.records(base).join(named, "scope_digest", "left"))

    def sweep(self, now: Column) -> int:
        """The version without the mappings that have expired at a time."""
        base = self._latest()
        return self._without(F.col("expires_at") <= now, base, self.records(base))

    def persist(self, replaced: DataFrame, now: Column) -> DataFrame:
        """The texts of ``tokens.replace_spans``, all or nothing, given out when their mappings are committed.

        Texts with a mapping that can't be stored are null (``tokens.persist``). A failure before the commit gives out no text and stores nothing.
        """
        base = self._latest()
        texts = kept(replaced, "replaced")
        held = self.records(base).where(F.col("expires_at") > now).withColumn("original", unseal(F.col("sealed"), self.key, self._bound()))
        names = texts.select("scope", F.explode("replacements").alias("r")).select("scope", "r.token").distinct().withColumns({"scope_digest": F.sha2("scope", 256), "token_digest": F.sha2("token", 256)})
        held = names.join(held, ["scope_digest", "token_digest"]).select("scope", "token", "original")
        out, new = tokens.persist(texts, held)
        out = kept(out, "texts")
        self.save(new.withColumn("at", now), base)
        return out
