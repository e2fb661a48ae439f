"""A table on disk: a commit log, sealed segments, indexes and a checksummed manifest, in any file system Spark can write.

Layout under the root: ``commits/epoch=N`` (one batch each), ``commits/_loads/N-M``
(batches N to M, loaded together), ``commits/_log/N`` (a small file that makes the
epoch, or the load's first one and all after it), ``receipts/<digest>`` (one per
idempotency key), ``segments/<id>`` (rows by table and tenant), ``indexes/<id>/<kind>``,
``checkpoints/<epoch>``, ``snapshots/<name>`` and ``manifest.json`` with a backup
beside it.

Several writers may append: a batch is written under a name of its own, and the
epoch is whoever first creates its file in the log, which the file system grants
once. Manifest generations are claimed the same way, so of two editors of one
generation one gets a conflict.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import re
import time
import uuid
from collections.abc import Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.errors import Conflict, Corrupt, InvalidCommand, NotFound, NotPermitted
from loomstone.model import TableSpec
from loomstone.operators import versions

COMMIT_SCHEMA = "table string, tenant_id string, record_id string, epoch long, ordinal long, op string, fields map<string,string>"
COLUMNS = [c.split()[0] for c in COMMIT_SCHEMA.split(", ")[:6]] + ["fields"]
OPERATIONS = ("put", "patch", "delete", "status")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*\Z")


def safe_name(name: str) -> str:
    """``name``, if it is one path component that cannot leave its folder."""
    if not _NAME.match(name) or ".." in name:
        raise NotPermitted(f"name {name!r} is not a plain file name")
    return name


class Files:
    """Small files and folders through Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.gateway = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _aside(self, name: str, text: str):
        path = self.path(f"{name.rpartition('/')[0]}/_aside-{uuid.uuid4().hex}".lstrip("/"))
        stream = self.fs.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return path

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written aside and renamed over what is there."""
        aside, target = self._aside(name, text), self.path(name)
        try:
            overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = overwrite
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(aside, target, options)
        except Py4JJavaError:  # file systems without an overwriting rename
            self.fs.delete(target, False)
            if not self.fs.rename(aside, target):
                raise Conflict(f"{name} could not be replaced") from None

    def claim(self, name: str, text: str) -> bool:
        """Creates a file with this text, if there is none: of several callers one succeeds."""
        target = self.path(name)
        if self.fs.getScheme() != "file":
            try:
                stream = self.fs.create(target, False)
            except Py4JJavaError:
                return False
            try:
                stream.write(bytearray(text.encode()))
            finally:
                stream.close()
            return True
        # A local file system checks and creates in two steps; a link is made in one.
        aside = self._aside(name, text)
        file = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            self.jvm.java.nio.file.Files.createLink(file(target), file(aside))
            return True
        except Py4JJavaError:
            return False
        finally:
            self.fs.delete(aside, False)

    def move(self, source: str, target: str) -> bool:
        return self.fs.rename(self.path(source), self.path(target))

    def make(self, folder: str) -> None:
        self.fs.mkdirs(self.path(folder))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def copy(self, source: str, target: str) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(source), self.fs, self.path(target), False, self.conf)


def _sealed(document: dict[str, Any]) -> str:
    body = json.dumps(document, sort_keys=True)
    return json.dumps({"checksum": hashlib.sha256(body.encode()).hexdigest(), "document": document}, sort_keys=True)


def _opened(text: str) -> dict[str, Any]:
    try:
        raw = json.loads(text)
        document, checksum = raw["document"], raw["checksum"]
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("manifest is not readable") from error
    if hashlib.sha256(json.dumps(document, sort_keys=True).encode()).hexdigest() != checksum:
        raise Corrupt("manifest checksum does not match")
    return document


#: Seconds after which a claim on a manifest generation that was never written may be taken over.
CLAIM_SECONDS = 60


class Store:
    """The stored state of tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        if not self.files.exists("manifest.json") and not self.files.exists("manifest.bak"):
            self._save({"generation": 0, "checkpoint": None, "floor": 0, "segments": [], "indexes": [], "tables": {}})
        self._settle()

    def manifest(self) -> dict[str, Any]:
        """The manifest and the newest epoch; its backup if the file is torn. A wrong checksum is refused even with a good backup."""
        try:
            document = _opened(self.files.read("manifest.json"))
        except Corrupt:
            raise
        except Exception as error:
            if not self.files.exists("manifest.bak"):
                raise Corrupt("no readable manifest") from error
            document = _opened(self.files.read("manifest.bak"))
        return {**document, "epoch": self.epoch()}

    def _save(self, document: dict[str, Any]) -> None:
        text = _sealed({k: v for k, v in document.items() if k != "epoch"})
        self.files.write("manifest.json", text)
        self.files.write("manifest.bak", text)

    def _edited(self, parent: int | None = None, **changes: Any) -> dict[str, Any]:
        """The manifest with changes, as its next generation; a conflict if another editor was first."""
        now = self.manifest()
        if parent is not None and now["generation"] != parent:
            raise Conflict(f"manifest generation is {now['generation']}, not {parent}")
        new = {**now, **changes, "generation": now["generation"] + 1}
        claim = f"_claims/{new['generation']}"
        if not self.files.claim(claim, str(time.time())):
            stale = False
            with contextlib.suppress(Py4JJavaError, ValueError):
                stale = time.time() - float(self.files.read(claim)) > CLAIM_SECONDS
            if not stale or self.manifest()["generation"] != now["generation"]:
                raise Conflict(f"manifest generation {new['generation']} is being written")
            self.files.delete(claim)
            if not self.files.claim(claim, str(time.time())):
                raise Conflict(f"manifest generation {new['generation']} is being written")
        if self.manifest()["generation"] != now["generation"]:
            raise Conflict(f"manifest generation is no longer {now['generation']}")
        self._save(new)
        self.files.delete(f"_claims/{now['generation']}")
        return new

    def _settled(self) -> int:
        """An epoch up to which all commits are in place: a hint that may lag."""
        try:
            return int(self.files.read("commits/_log/_settled"))
        except (Py4JJavaError, ValueError):
            return 0

    def epoch(self) -> int:
        """The newest committed epoch. Log files after the settled one are probed, never listed."""
        at = self._settled()
        with contextlib.suppress(ValueError):  # an entry that another writer is just writing is not there yet
            while self.files.exists(f"commits/_log/{at + 1}"):
                at = self._entry(at + 1)["last"]
        return at

    def _entry(self, epoch: int) -> dict[str, Any]:
        """What the log says of an epoch; of a load, with its last one."""
        return {"last": epoch, **json.loads(self.files.read(f"commits/_log/{epoch}"))}

    def _settle(self) -> None:
        """Puts commits into place whose writers have died between the log and the last step. Any process may do it, again and again."""
        at = settled = self._settled()
        while self.files.exists(f"commits/_log/{at + 1}"):
            entry = self._entry(at + 1)
            place = f"commits/_loads/{at + 1}-{entry['last']}" if entry.get("load") else f"commits/epoch={at + 1}"
            at = entry["last"]
            if self.files.exists(entry["pending"]):
                self.files.delete(place)
                if entry.get("load"):
                    self.files.make("commits/_loads")
                if not self.files.move(entry["pending"], place) and self.files.exists(entry["pending"]):
                    raise Conflict(f"commit {at} could not be put into place")
            if entry.get("receipt"):
                self.files.claim(entry["receipt"], json.dumps({"epoch": at, "body": entry["body"]}))
        if at > settled:
            self.files.write("commits/_log/_settled", str(at))

    def apply_schema(self, spec: TableSpec) -> None:
        """Adds or replaces a table's spec, within the rules of evolution."""
        tables = self.manifest()["tables"]
        if spec.name in tables:
            has_rows = not self.commits().where(F.col("table") == spec.name).isEmpty()
            TableSpec.from_dict(tables[spec.name]).accepts(spec, has_rows)
        self._edited(tables={**tables, spec.validate().name: spec.to_dict()})

    def append(self, batch: DataFrame, idempotency_key: str | None = None) -> int:
        """Commits a batch under one new epoch and returns that epoch.

        ``batch`` has the columns of a commit but epoch; within a key the last
        ordinal wins. An empty batch and an unknown operation are refused before
        anything is written. A repeated idempotency key with the same rows is a
        replay; with other rows it is a conflict.
        """
        body = [F.to_json("fields") if c == "fields" else F.col(c) for c in batch.columns]
        digest = batch.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*body).cast("decimal(38,0)")).alias("h"), F.count_if(~F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False))).alias("bad")).first()
        if not digest.n:
            raise InvalidCommand("a batch must have rows")
        if digest.bad:
            raise InvalidCommand(f"operations are {', '.join(OPERATIONS)}")
        entry = {"pending": f"commits/_pending-{uuid.uuid4().hex}", "body": f"{digest.n}:{digest.h}"}
        if idempotency_key is not None:
            entry["receipt"] = f"receipts/{hashlib.sha256(idempotency_key.encode()).hexdigest()}"
        written = False
        while True:
            self._settle()
            if "receipt" in entry and self.files.exists(entry["receipt"]):
                known = json.loads(self.files.read(entry["receipt"]))
                self.files.delete(entry["pending"])
                if known["body"] != entry["body"]:
                    raise Conflict(f"idempotency key {idempotency_key!r} was used with another body")
                return known["epoch"]
            if not written:
                batch.withColumn("epoch", F.lit(0).cast("long")).select(*COLUMNS).drop("epoch").write.parquet(f"{self.root}/{entry['pending']}")
                written = True
                continue  # others may have committed meanwhile
            epoch = self.epoch() + 1
            if self.files.claim(f"commits/_log/{epoch}", json.dumps(entry)):
                self._settle()
                return epoch

    def append_epochs(self, rows: DataFrame) -> int:
        """Commits a table of batches that already have their epochs, ``1..n`` after the newest, in one job; returns the newest.

        For loading a log: all its epochs are one entry of the log and one folder,
        in files by ranges of epochs, so the cost follows the rows and not the
        number of epochs. A log to which anything was added meanwhile refuses it.
        """
        self._settle()
        first = self.epoch() + 1
        told = rows.agg(F.min("epoch").alias("low"), F.max("epoch").alias("high"), F.countDistinct("epoch").alias("n"), F.count_if(~F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False))).alias("bad")).first()
        if not told.n or told.low != first or told.high - told.low + 1 != told.n:
            raise InvalidCommand(f"epochs must run from {first} without gaps")
        if told.bad:
            raise InvalidCommand(f"operations are {', '.join(OPERATIONS)}")
        aside = f"commits/_pending-{uuid.uuid4().hex}"
        rows.select(*COLUMNS).repartitionByRange("epoch", "ordinal").sortWithinPartitions("epoch", "ordinal").write.parquet(f"{self.root}/{aside}")
        if not self.files.claim(f"commits/_log/{first}", json.dumps({"pending": aside, "body": "", "load": True, "last": told.high})):
            self.files.delete(aside)
            raise Conflict(f"epoch {first} was committed by another writer")
        self._settle()
        return told.high

    def _loads(self) -> list[tuple[int, int]]:
        """First and last epochs of the loads in place."""
        return sorted(tuple(map(int, n.split("-"))) for n in self.files.names("commits/_loads"))

    def commits(self, after: int = 0) -> DataFrame:
        """Committed changes after an epoch. Folders of epochs that the log does not name are not read."""
        newest = self.epoch()
        if newest <= after or not self.files.exists("commits"):
            return self.spark.createDataFrame([], COMMIT_SCHEMA).select(*COLUMNS)
        rows = self.spark.read.schema(COMMIT_SCHEMA).parquet(f"{self.root}/commits").select(*COLUMNS)
        loads = [f"{self.root}/commits/_loads/{low}-{high}" for low, high in self._loads() if high > after and low <= newest]
        if loads:
            rows = rows.unionByName(self.spark.read.schema(COMMIT_SCHEMA).parquet(*loads).select(*COLUMNS))
        return rows.where((F.col("epoch") > after) & (F.col("epoch") <= newest))

    def history(self, table: str, columns: Sequence[str], epoch: int | None = None) -> DataFrame:
        """Commits that lead to a table's state: the checkpoint as puts and what came after, or all of them for an earlier epoch.

        An epoch whose commits were dropped behind a checkpoint is not found.
        """
        now = self.manifest()
        at = now["checkpoint"]
        if epoch is not None and epoch < now["floor"]:
            raise NotFound(f"commits up to epoch {now['floor']} were dropped; epoch {epoch} cannot be read")
        whole = at is None or (epoch is not None and epoch < at)
        tail = self.commits(0 if whole else at).where(F.col("table") == table).drop("table")
        if epoch is not None:
            tail = tail.where(F.col("epoch") <= epoch)
        if whole:
            return tail
        rows = self.spark.read.parquet(f"{self.root}/checkpoints/{at}").where(F.col("table") == table)
        base = rows.select("tenant_id", "record_id", F.col("version_id").alias("epoch"), F.lit(0).cast("long").alias("ordinal"), "op", "fields")
        return base.unionByName(tail)

    def state(self, table: str, columns: Sequence[str], epoch: int | None = None) -> DataFrame:
        """Live records with the merged columns."""
        return versions.state_at(self.history(table, columns, epoch), None, columns)

    def checkpoint(self, drop_commits: bool = False) -> int:
        """Writes every table's live rows and deleted keys at the newest epoch; commits up to it may then go."""
        now = self.manifest()
        epoch = now["epoch"]
        if now["checkpoint"] == epoch:
            if drop_commits and now["floor"] < epoch:
                self._edited(floor=epoch)
                self._drop(epoch)
            return epoch
        parts = []
        from loomstone.sources.tables import columns_of, status_field, statuses

        for name, raw in now["tables"].items():
            spec = TableSpec.from_dict(raw)
            columns = columns_of(spec)
            history = self.history(name, columns)
            rows = versions.state_at(history, None, columns).join(statuses(history, spec), list(versions.KEY))
            rows = rows.withColumns({status_field(v.name): F.col("feature_status")[v.name] for v in spec.vectors})
            pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"`{c}`") for c in columns]))
            parts.append(rows.select(F.lit(name).alias("table"), "tenant_id", "record_id", "version_id", F.lit("put").alias("op"), F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("fields")))
            # Deleted keys stay known: a sealed segment may still hold them.
            gone = versions.versions(history).where("tombstone is not null and end_epoch is null")
            parts.append(gone.select(F.lit(name).alias("table"), "tenant_id", "record_id", "version_id", F.lit("delete").alias("op"), F.create_map().cast("map<string,string>").alias("fields")))
        if not parts:
            raise NotFound("no table to check point")
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        self.files.delete(f"checkpoints/{epoch}")
        rows.write.parquet(f"{self.root}/checkpoints/{epoch}")
        self._edited(checkpoint=epoch, floor=epoch if drop_commits else now["floor"])
        if drop_commits:
            self._drop(epoch)
        return epoch

    def _drop(self, epoch: int) -> None:
        """Deletes commits and log files up to a checkpoint that the manifest names."""
        for n in self.files.names("commits"):
            if n.startswith("epoch=") and int(n[6:]) <= epoch:
                self.files.delete(f"commits/{n}")
        for low, high in self._loads():
            if high <= epoch:
                self.files.delete(f"commits/_loads/{low}-{high}")
        for n in self.files.names("commits/_log"):
            if n.isdecimal() and int(n) <= epoch:
                self.files.delete(f"commits/_log/{n}")

    def publish(self, segment: str, rows: DataFrame, parent: int | None = None, supersede: bool = False) -> dict[str, Any]:
        """Adds a sealed segment of ``table, tenant_id, ...`` rows, in files by table and tenant.

        Publishing the same id again changes nothing. ``parent`` is the manifest
        generation that the caller has read; another one is a conflict. With
        ``supersede`` the segment takes the place of what older ones hold of its
        own tables; their other tables stay.
        """
        now = self.manifest()
        if any(s["id"] == segment for s in now["segments"]):
            return now
        if parent is not None and parent != now["generation"]:
            raise Conflict(f"manifest generation is {now['generation']}, not {parent}")
        path = f"{self.root}/segments/{safe_name(segment)}"
        write_partitioned(rows, path)
        written = self.spark.read.parquet(path)
        tables = sorted(r.table for r in written.select("table").distinct().collect())
        own = {"id": segment, "epoch": now["epoch"], "tables": tables, "checksum": checksum(written)}
        older = [{**s, "tables": [t for t in s["tables"] if t not in tables]} for s in now["segments"]] if supersede else now["segments"]
        kept = [s for s in older if s["tables"]]
        alive = {s["id"] for s in kept} | {segment}
        return self._edited(parent, segments=[*kept, own], indexes=[i for i in now["indexes"] if i["segment"] in alive and not (supersede and i["table"] in tables)])

    def compact(self, table: str, columns: Sequence[str]) -> str:
        """One new segment of a table's live rows in place of that table's older ones; other tables are not touched."""
        now = self.manifest()
        name = f"compact-{now['epoch']}-{uuid.uuid4().hex[:8]}"
        rows = self.state(table, columns).select(F.lit(table).alias("table"), "*")
        if rows.isEmpty():
            kept = [{**s, "tables": [t for t in s["tables"] if t != table]} for s in now["segments"]]
            self._edited(now["generation"], segments=[s for s in kept if s["tables"]], indexes=[i for i in now["indexes"] if i["table"] != table])
            return name
        self.publish(name, rows, now["generation"], supersede=True)
        return name

    def segment_rows(self, table: str | None = None) -> DataFrame:
        """Rows that published segments hold, of one table or all. Filters on table and tenant_id prune files."""
        parts = []
        for s in self.manifest()["segments"]:
            tables = [t for t in s["tables"] if table is None or t == table]
            if tables:
                parts.append(self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/segments/{s['id']}").where(F.col("table").isin(*tables)))
        if not parts:
            raise NotFound("no segment is published")
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def verify(self) -> list[str]:
        """Ids of segments whose rows are not those that were published."""
        return [s["id"] for s in self.manifest()["segments"] if checksum(self.spark.read.parquet(f"{self.root}/segments/{s['id']}")) != s["checksum"]]

    def build_index(self, segment: str, table: str, kind: str, rows: DataFrame) -> dict[str, Any]:
        """Writes an index of one table of a segment and names it in the manifest; a second build of the same changes nothing."""
        now = self.manifest()
        if not any(s["id"] == segment and table in s["tables"] for s in now["segments"]):
            raise NotFound(f"no segment {segment!r} of table {table!r}")
        if any((i["segment"], i["table"], i["kind"]) == (segment, table, kind) for i in now["indexes"]):
            return now
        path = f"indexes/{safe_name(segment)}/{safe_name(table)}/{safe_name(kind)}"
        self.files.delete(path)
        rows.write.parquet(f"{self.root}/{path}")
        own = {"segment": segment, "table": table, "kind": kind, "checksum": checksum(self.spark.read.parquet(f"{self.root}/{path}"))}
        return self._edited(now["generation"], indexes=[*now["indexes"], own])

    def read_index(self, segment: str, table: str, kind: str) -> DataFrame:
        """An index of one table of a segment; refused if its rows are not those that were written."""
        for i in self.manifest()["indexes"]:
            if (i["segment"], i["table"], i["kind"]) == (segment, table, kind):
                rows = self.spark.read.parquet(f"{self.root}/indexes/{segment}/{table}/{kind}")
                if checksum(rows) != i["checksum"]:
                    raise Corrupt(f"{kind} index of {segment} does not match its checksum")
                return rows
        raise NotFound(f"no {kind} index of {table!r} in {segment!r}")

    def vacuum(self) -> int:
        """Deletes segments, tables of segments, indexes and checkpoints that the manifest does not name; returns how many."""
        now = self.manifest()
        kept = {s["id"]: set(s["tables"]) for s in now["segments"]}
        gone = [f"segments/{n}" for n in self.files.names("segments") if n not in kept]
        for name, tables in kept.items():
            gone += [f"segments/{name}/{n}" for n in self.files.names(f"segments/{name}") if n.startswith("table=") and n[6:] not in tables]
        indexed = {i["segment"] for i in now["indexes"]}
        gone += [f"indexes/{n}" for n in self.files.names("indexes") if n not in indexed]
        gone += [f"checkpoints/{n}" for n in self.files.names("checkpoints") if n != str(now["checkpoint"])]
        for name in gone:
            self.files.delete(name)
        return len(gone)

    def snapshot(self, name: str) -> str:
        """A copy of everything under ``snapshots/<name>``; an existing one is not touched."""
        target = f"snapshots/{safe_name(name)}"
        if self.files.exists(target):
            raise Conflict(f"snapshot {name!r} exists")
        self._copy_to(target)
        return f"{self.root}/{target}"

    def _copy_to(self, target: str) -> None:
        for part in PARTS:
            if self.files.exists(part):
                self.files.copy(part, f"{target}/{part}")

    def backup(self, target: str) -> None:
        """A copy of everything in another folder, of this or another file system; it must not exist."""
        other = Files(self.spark, target)
        if other.exists(""):
            raise Conflict(f"{target!r} exists")
        for part in PARTS:
            if self.files.exists(part):
                self.files.jvm.org.apache.hadoop.fs.FileUtil.copy(self.files.fs, self.files.path(part), other.fs, other.path(part), False, self.files.conf)

    def restore(self, name: str) -> None:
        """Back to a snapshot. Everything is copied aside first, so a failed copy changes nothing."""
        source = f"snapshots/{safe_name(name)}"
        if not self.files.exists(f"{source}/manifest.json"):
            raise NotFound(f"no snapshot {name!r}")
        _opened(self.files.read(f"{source}/manifest.json"))
        aside = f"_restore-{uuid.uuid4().hex}"
        for part in PARTS:
            if self.files.exists(f"{source}/{part}"):
                self.files.copy(f"{source}/{part}", f"{aside}/{part}")
        self.files.delete("_claims")
        for part in PARTS:
            self.files.delete(part)
            if self.files.exists(f"{aside}/{part}"):
                self.files.move(f"{aside}/{part}", part)
        self.files.delete(aside)


#: What a snapshot holds, in the order in which a restore puts it back.
PARTS = ("commits", "receipts", "segments", "indexes", "checkpoints", "manifest.bak", "manifest.json")


def checksum(rows: DataFrame) -> str:
    """Number of rows and the sum of their hashes: the same in any order and any split into files."""
    columns = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in sorted(rows.schema, key=lambda f: f.name)]
    r = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n}:{r.h}"


def write_partitioned(rows: DataFrame, path: str) -> None:
    """Files by table and tenant, each tenant's rows spread over the writing tasks that have them.

    A rebalance before the write splits large tenants and joins small ones, so a
    hot tenant is several files and a small one is not a file per task.
    """
    rows.hint("rebalance", "table", "tenant_id").write.mode("overwrite").partitionBy("table", "tenant_id").parquet(path)


def read_segment(spark: SparkSession, path: str, table: str, tenant_id: str) -> DataFrame:
    """A tenant's sealed rows; only its folder is listed and read."""
    return spark.read.parquet(path).where((F.col("table") == table) & (F.col("tenant_id") == tenant_id))


def segment_sets(rows: DataFrame) -> DataFrame:
    """Sorted distinct tables and tenants of a segment, in one row."""
    few = rows.select("table", "tenant_id").distinct()
    return few.agg(F.array_sort(F.collect_set("table")).alias("table_set"), F.array_sort(F.collect_set("tenant_id")).alias("tenant_set"))
