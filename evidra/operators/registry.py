"""Governed tables as an event log: data files become visible by commit files that are created exclusively.

A commit is one JSON file ``_commits/NNNNNNNN.json`` that names the Parquet folders it adds and the folders it takes away. The number is taken
by creating the file without overwriting; if another writer has it, the checks run again on what it wrote. Nothing
is updated in place: a version's state is that of its latest event, and the audit log only grows. Readers build one scan over
the folders of all commits, so table size never meets the driver; the number of commits does.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType
from pyspark.sql.window import Window

from .. import schema

_EVENT = StructType(
    [
        StructField("version_id", StringType()), StructField("status", StringType()), StructField("snapshot_path", StringType()),
        StructField("snapshot_manifest_sha256", StringType()), StructField("approved_at", TimestampType()), StructField("seq", LongType()),
    ]
)
_VERSION = StructType([f for f in schema.VERSION if f.name in ("id", "guideline_id", "version_label", "published_at", "created_at")])
TABLES = {
    "guideline": schema.GUIDELINE, "version": _VERSION, "version_event": _EVENT, "source_file": schema.SOURCE_FILE, "raw_chunk": schema.RAW_CHUNK,
    "node": schema.NODE, "version_diff": schema.VERSION_DIFF, "audit_event": schema.AUDIT_EVENT,
}
COUNTED = ["guideline", "document_version", "source_file", "raw_chunk", "node", "version_diff", "audit_event"]
PLACEHOLDER = "\x00"


class Conflict(RuntimeError):
    """Another writer took the commit number again and again."""


def latest_state(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key; the window keeps one row of a key before the shuffle."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*map(F.desc, order))) == 1
    return events.withColumn("_last", last).where("_last").drop("_last")


def nest_versions(versions: DataFrame) -> DataFrame:
    """(guideline_id, versions): each guideline's versions (id, version_label, status) in order of creation; a guideline has few."""
    rows = F.array_sort(F.collect_list(F.struct("created_at", "id", "version_label", "status")))
    fields = lambda v: F.struct(v["id"].alias("id"), v["version_label"].alias("version_label"), v["status"].alias("status"))
    return versions.groupBy("guideline_id").agg(F.transform(rows, fields).alias("versions"))


def chunks_of_version(files: DataFrame, chunks: DataFrame, version_id: object) -> DataFrame:
    """The chunks of a version's source files; Spark broadcasts the files where their size allows."""
    own = files.where(F.col("document_version_id") == version_id).select(F.col("id").alias("source_file_id"))
    return chunks.join(own, "source_file_id", "left_semi")


class Registry:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("_commits"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # Commits

    def commits(self) -> list[dict]:
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("_commits")))
        names = [n for n in names if n.endswith(".json") and n[:-5].isdigit()]
        rows = self.spark.read.text([f"{self.root}/_commits/{n}" for n in names], wholetext=True).collect() if names else []
        return sorted((json.loads(r["value"]) for r in rows), key=lambda c: c["seq"])

    def _publish(self, commit: dict) -> bool:
        target = self._path(f"_commits/{commit['seq']:08d}.json")
        try:
            out = self._fs.create(target, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or self._fs.exists(target):
                return False
            raise
        out.write(bytearray(json.dumps(commit, sort_keys=True).encode()))
        out.close()
        return True

    def commit(self, make: Callable[[int], tuple[dict[str, DataFrame], dict[str, list[str]]]], attempts: int = 5) -> int:
        """Publish what ``make(seq)`` gives: rows to append by table, and folders to take away by table. It checks its
        preconditions itself, each time it is called."""
        for _ in range(attempts):
            past = self.commits()
            seq = past[-1]["seq"] + 1 if past else 1
            appends, removes = make(seq)
            adds = {}
            for table, rows in appends.items():
                folder = f"data/{table}/{uuid.uuid4().hex}"
                rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table])).write.parquet(f"{self.root}/{folder}")
                adds[table] = [folder]
            if self._publish({"seq": seq, "add": adds, "remove": removes}):
                return seq
            for folders in adds.values():
                for f in folders:
                    self._fs.delete(self._path(f), True)
        raise Conflict("the registry is too busy")

    def folders(self, table: str) -> list[str]:
        live: list[str] = []
        for c in self.commits():
            gone = set(c["remove"].get(table, []))
            live = [f for f in live if f not in gone] + c["add"].get(table, [])
        return live

    def table(self, name: str) -> DataFrame:
        folders = self.folders(name)
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.root}/{f}" for f in folders))

    # Reads

    def versions(self) -> DataFrame:
        """Versions with the state of their latest event."""
        state = latest_state(self.table("version_event"), "version_id", "seq").select(F.col("version_id").alias("id"), "status", "snapshot_path", "snapshot_manifest_sha256", "approved_at")
        return self.table("version").join(state, "id").select(*schema.VERSION.names)

    def get(self, table: str, key: str) -> Row:
        df = self.versions() if table == "version" else self.table(table)
        found = df.where(F.col("id") == key).limit(1).collect()
        if not found:
            raise KeyError(f"unknown {table} {key}")
        return found[0]

    def list_guidelines(self) -> DataFrame:
        return self.table("guideline").orderBy("id")

    def list_versions(self, guideline_id: str | None = None) -> DataFrame:
        v = self.versions()
        return (v.where(F.col("guideline_id") == guideline_id) if guideline_id else v).orderBy("guideline_id", "created_at", "id")

    def list_searchable_versions(self) -> DataFrame:
        return self.versions().where("status = 'active'").orderBy("guideline_id", "approved_at", "id")

    def guideline_listing(self) -> DataFrame:
        """Guidelines with their versions nested, in order of creation."""
        nested = nest_versions(self.versions())
        return self.table("guideline").join(nested.withColumnRenamed("guideline_id", "id"), "id", "left").orderBy("id")

    def version_chunks(self, version_id: str) -> DataFrame:
        """A version's chunks in source order: the registry's one relational join."""
        return chunks_of_version(self.table("source_file"), self.table("raw_chunk"), version_id).orderBy("source_ordinal", "id")

    def count_nodes(self, version_id: str) -> int:
        return self.table("node").where(F.col("document_version_id") == version_id).count()

    def count_rows(self, table: str) -> int:
        if table not in COUNTED:
            raise ValueError(f"no table {table}")
        return self.table({"document_version": "version"}.get(table, table)).count()

    def list_version_diffs(self, prior: str, current: str) -> DataFrame:
        return self.table("version_diff").where((F.col("prior_version_id") == prior) & (F.col("current_version_id") == current)).orderBy("chunk_id")

    def list_audit(self) -> DataFrame:
        return self.table("audit_event").orderBy("id")

    # Writes: each is one commit with its audit rows

    def _one(self, table: str, **values: object) -> DataFrame:
        kinds = TABLES[table]
        row = self.spark.range(1)
        return row.select(*(F.current_timestamp().alias(f.name) if f.name == "created_at" else F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in kinds))

    def _audit(self, actor: str, action: str, kind: str, ids: DataFrame | Sequence[str], payload: dict | None = None) -> DataFrame:
        """Audit rows for entities (``ids``: a table with one column, or values), numbered after the last one."""
        if not actor.strip():
            raise ValueError("actor must not be blank")
        before = self.table("audit_event").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        if not isinstance(ids, DataFrame):
            ids = self.spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("entity_id"))
        ids = ids.toDF("entity_id")
        # A commit's entities are numbered in id order; commits are as large as a document version.
        n = F.row_number().over(Window.orderBy("entity_id"))
        return ids.select(
            (n + before).cast("long").alias("id"), F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.lit(kind).alias("entity_type"),
            "entity_id", F.lit(json.dumps(payload or {}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))).alias("payload_json"), F.current_timestamp().alias("created_at"),
        )

    def record_audit(self, actor: str, action: str, kind: str, entity: str, payload: dict | None = None) -> int:
        self.commit(lambda seq: ({"audit_event": self._audit(actor, action, kind, [entity], payload)}, {}))
        return self.table("audit_event").agg(F.max("id")).first()[0]

    def _absent(self, table: str, key: str) -> None:
        if not self.table(table).where(F.col("id") == key).isEmpty():
            raise ValueError(f"{table} {key} exists")

    def create_guideline(self, actor: str, **fields: object) -> None:
        if fields.get("authority_level") not in schema.AUTHORITY_LEVELS:
            raise ValueError("unknown authority level")

        def make(seq: int):
            self._absent("guideline", fields["id"])
            return {"guideline": self._one("guideline", **fields), "audit_event": self._audit(actor, "guideline_created", "guideline", [fields["id"]])}, {}

        self.commit(make)

    def create_draft_version(self, actor: str, **fields: object) -> None:
        def make(seq: int):
            self.get("guideline", fields["guideline_id"])
            self._absent("version", fields["id"])
            same = (F.col("guideline_id") == fields["guideline_id"]) & (F.col("version_label") == fields["version_label"])
            if not self.table("version").where(same).isEmpty():
                raise ValueError("the guideline has a version of that label")
            return {
                "version": self._one("version", **fields),
                "version_event": self._one("version_event", version_id=fields["id"], status="draft", seq=seq),
                "audit_event": self._audit(actor, "draft_version_created", "document_version", [fields["id"]]),
            }, {}

        self.commit(make)

    def add_source_file(self, actor: str, **fields: object) -> None:
        def make(seq: int):
            self.get("version", fields["document_version_id"])
            self._absent("source_file", fields["id"])
            return {"source_file": self._one("source_file", **fields), "audit_event": self._audit(actor, "source_file_added", "source_file", [fields["id"]])}, {}

        self.commit(make)

    def _bulk(self, actor: str, table: str, rows: DataFrame, key: str, action: str) -> None:
        def make(seq: int):
            if not rows.groupBy(key).count().where("count > 1").isEmpty():
                raise ValueError(f"{table} rows with the same {key}")
            if not rows.join(self.table(table).select(key), key, "left_semi").isEmpty():
                raise ValueError(f"{table} rows exist")
            return {table: rows, "audit_event": self._audit(actor, action, table, rows.select(key))}, {}

        self.commit(make)

    def add_raw_chunks(self, actor: str, rows: DataFrame) -> None:
        self._bulk(actor, "raw_chunk", rows, "id", "raw_chunk_added")

    def add_node_manifest(self, actor: str, rows: DataFrame) -> None:
        self._bulk(actor, "node", rows, "node_id", "node_added")

    def _event(self, v: Row, seq: int, status: str, approved: bool = False, **changes: object) -> DataFrame:
        fields = {"snapshot_path": v["snapshot_path"], "snapshot_manifest_sha256": v["snapshot_manifest_sha256"], "approved_at": v["approved_at"], **changes}
        row = self._one("version_event", version_id=v["id"], status=status, seq=seq, **fields)
        return row.withColumn("approved_at", F.current_timestamp()) if approved else row

    def set_draft_snapshot(self, actor: str, version_id: str, path: str, manifest_sha256: str) -> None:
        def make(seq: int):
            v = self.get("version", version_id)
            if v["status"] != "draft":
                raise ValueError("only a draft takes a snapshot")
            event = self._event(v, seq, "draft", snapshot_path=path, snapshot_manifest_sha256=manifest_sha256)
            return {"version_event": event, "audit_event": self._audit(actor, "snapshot_registered", "document_version", [version_id])}, {}

        self.commit(make)

    def approve_version(self, actor: str, version_id: str) -> None:
        """A draft becomes active and the active version of its guideline superseded, in one commit; both get the time of approval."""

        def make(seq: int):
            v = self.get("version", version_id)
            if v["status"] != "draft":
                raise ValueError("only a draft can be approved")
            if not v["snapshot_path"]:
                raise ValueError("a version without a snapshot can't be approved")
            rows = self._event(v, seq, "active", approved=True)
            for old in self.versions().where((F.col("guideline_id") == v["guideline_id"]) & (F.col("status") == "active")).collect():
                rows = rows.unionByName(self._event(old, seq, "superseded", approved=True))
            return {"version_event": rows, "audit_event": self._audit(actor, "version_approved", "document_version", [version_id])}, {}

        self.commit(make)

    def archive_version(self, actor: str, version_id: str) -> None:
        def make(seq: int):
            v = self.get("version", version_id)
            if v["status"] != "superseded":
                raise ValueError("only a superseded version can be archived")
            return {"version_event": self._event(v, seq, "archived"), "audit_event": self._audit(actor, "version_archived", "document_version", [version_id])}, {}

        self.commit(make)

    def replace_version_diffs(self, actor: str, rows: DataFrame) -> None:
        """Put a pair's diff rows in the place of those stored; no rows change nothing, several pairs are an error."""
        pairs = rows.select("prior_version_id", "current_version_id").distinct().limit(2).collect()
        if not pairs:
            return
        if len(pairs) > 1:
            raise ValueError("diff rows of several version pairs")
        prior, current = pairs[0]
        n = rows.count()

        def make(seq: int):
            old = self.folders("version_diff")
            same = (F.col("prior_version_id") == prior) & (F.col("current_version_id") == current)
            gone = [f for f in old if not self.spark.read.parquet(f"{self.root}/{f}").where(same).isEmpty()]  # a folder holds one pair
            audit = self._audit(actor, "version_diff_replaced", "version_diff", [f"{prior}:{current}"], {"record_count": n})
            return {"version_diff": rows, "audit_event": audit}, {"version_diff": gone}

        self.commit(make)

    def rebase_paths(self, actor: str, old_root: str, new_root: str | None = None) -> int:
        """Absolute paths under ``old_root`` become relative to it, all in one commit; a second call changes nothing.

        With ``new_root``, where relative paths are looked up from now on, each path must exist there, else nothing changes.
        """
        prefix = old_root.rstrip("/") + "/"
        files = self.table("source_file")
        moved = files.where(F.col("managed_path").startswith(prefix))
        n = moved.count()
        versions = [v for v in self.versions().where(F.col("snapshot_path").startswith(prefix)).collect()]
        if not n and not versions:
            return 0
        if new_root is not None:
            paths = itertools.chain((r["managed_path"] for r in moved.select("managed_path").toLocalIterator()), (v["snapshot_path"] for v in versions))
            jvm = self.spark.sparkContext._jvm
            top = jvm.org.apache.hadoop.fs.Path(new_root)
            fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for path in paths:
                if not fs.exists(jvm.org.apache.hadoop.fs.Path(top, path[len(prefix) :])):
                    raise FileNotFoundError(f"{path} does not exist below {new_root}")

        def make(seq: int):
            out: dict[str, DataFrame] = {"audit_event": self._audit(actor, "paths_rebased", "registry", ["registry"], {"path_count": n + len(versions)})}
            if n:
                out["source_file"] = files.withColumn("managed_path", F.when(F.col("managed_path").startswith(prefix), F.substring("managed_path", len(prefix) + 1, 1_000_000)).otherwise(F.col("managed_path")))
            events = [self._event(v, seq, v["status"], snapshot_path=v["snapshot_path"][len(prefix) :]) for v in versions]
            if events:
                whole = events[0]
                for e in events[1:]:
                    whole = whole.unionByName(e)
                out["version_event"] = whole
            return out, {"source_file": self.folders("source_file")} if n else {}

        self.commit(make)
        return n + len(versions)
