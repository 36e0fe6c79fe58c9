"""Immutable index snapshots: Parquet folders with a canonical manifest, built aside and renamed into place."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval

SAFE_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
RESERVED = {"con", "prn", "aux", "nul", *(f"{k}{i}" for k in ("com", "lpt") for i in range(1, 10))}


def safe_name(name: str) -> str:
    """A path component that is safe everywhere; anything else is an error."""
    if not SAFE_NAME.fullmatch(name) or ".." in name or name.endswith(".") or name.split(".")[0].lower() in RESERVED:
        raise ValueError(f"unsafe name {name!r}")
    return name


def model_profile(provider: str, model_name: str, dimension: int, normalize: bool, revision: str | None = None) -> dict[str, object]:
    """The encoder's profile as manifests hold it. The old provider name counts as local, and only local ones have a revision."""
    provider = {"huggingface": "local"}.get(provider, provider)
    if provider not in ("local", "remote"):
        raise ValueError(f"unknown provider {provider}")
    if isinstance(dimension, bool) or not isinstance(dimension, int) or dimension <= 0:
        raise ValueError("dimension must be a positive integer")
    if not isinstance(normalize, bool):
        raise ValueError("normalize must be a boolean")
    out: dict[str, object] = {"provider": provider, "model_name": model_name, "dimension": dimension, "normalize": normalize}
    if provider == "local" and revision:
        out["revision"] = revision
    return out


def canonical(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode() + b"\n"


def component_hashes(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of every file below ``path``, by its relative name; hashed on executors, and a snapshot has few files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.sha2("content", 256).alias("h")).collect()
    root = re.sub("^file:/+", "/", path.rstrip("/")) + "/"
    named = {re.sub("^file:/+", "/", r["path"]).removeprefix(root): r["h"] for r in rows}
    return {k: v for k, v in sorted(named.items()) if not k.rsplit("/", 1)[-1].startswith(("_", ".")) and k != "manifest.json"}


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, profile: dict[str, object]) -> None:
        self.spark, self.root, self.profile = spark, root.rstrip("/"), profile
        self._verified: set[tuple[str, str]] = set()

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, guideline_id: str, version_id: str) -> str:
        return f"{self.root}/{safe_name(guideline_id)}/{safe_name(version_id)}"

    def build(self, guideline_id: str, version_id: str, nodes: DataFrame) -> tuple[str, str]:
        """Write nodes, postings and statistics of a version; its folder and the digest of its manifest. Never overwrites."""
        final = self.path(guideline_id, version_id)
        target, fs = self._fs(final)
        if fs.exists(target):
            raise FileExistsError(f"snapshot {final} exists")
        wrong = nodes.where(F.size("embedding") != self.profile["dimension"]).limit(1).collect()
        if wrong:
            raise ValueError(f"node {wrong[0]['node_id']} has a vector of a wrong size")
        staging = f"{self.root}/{guideline_id}/.{version_id}.staging-{uuid.uuid4().hex}"
        aside, _ = self._fs(staging)
        try:
            nodes.repartitionByRange(max(1, nodes.sparkSession.sparkContext.defaultParallelism // 4), "node_id").sortWithinPartitions("node_id").write.parquet(f"{staging}/nodes")
            written = self.spark.read.parquet(f"{staging}/nodes")
            postings, stats = retrieval.build_inverted_index(written)
            postings.repartition("token").sortWithinPartitions("token").write.parquet(f"{staging}/postings")
            stats.coalesce(1).write.parquet(f"{staging}/stats")
            inventory = written.agg(
                F.count(F.lit(1)).alias("n"), F.count_distinct("node_id").alias("ids"), F.sha2(F.array_join(F.array_sort(F.collect_list("node_id")), "\n"), 256).alias("digest")
            ).first()
            if inventory["n"] != inventory["ids"]:
                raise ValueError("node ids must be unique")
            manifest = {
                "component_hashes": component_hashes(self.spark, staging), "guideline_id": guideline_id, "version_id": version_id, "index_id": f"{guideline_id}:{version_id}",
                "model": self.profile, "node_count": inventory["n"], "node_ids_sha256": inventory["digest"],
            }
            body = canonical(manifest)
            out = fs.create(self._fs(f"{staging}/manifest.json")[0], False)
            out.write(bytearray(body))
            out.close()
            if not fs.rename(aside, target):
                raise FileExistsError(f"snapshot {final} exists")
        except BaseException:
            fs.delete(aside, True)
            raise
        digest = hashlib.sha256(body).hexdigest()
        self.verify(guideline_id, version_id, digest)
        return final, digest

    def verify(self, guideline_id: str, version_id: str, manifest_sha256: str, path: str | None = None) -> dict[str, object]:
        """Check a snapshot's place, manifest, model, files and nodes; the manifest. Each manifest is checked once in a session."""
        final = self.path(guideline_id, version_id)
        if path is not None and path.rstrip("/") != final:
            raise ValueError("the snapshot is not in its place")
        raw = self.spark.read.text(f"{final}/manifest.json", wholetext=True).first()["value"].encode()
        if hashlib.sha256(raw).hexdigest() != manifest_sha256:
            raise ValueError("the manifest is not the one registered")
        manifest = json.loads(raw)
        if canonical(manifest) != raw:
            raise ValueError("the manifest is not canonical")
        if (manifest["guideline_id"], manifest["version_id"]) != (guideline_id, version_id):
            raise ValueError("the manifest is of another version")
        if model_profile(**manifest["model"]) != self.profile:
            raise ValueError("the snapshot was made with another encoder")
        if (final, manifest_sha256) in self._verified:
            return manifest
        if component_hashes(self.spark, final) != manifest["component_hashes"]:
            raise ValueError("files of the snapshot are missing, changed or added")
        nodes = self.spark.read.parquet(f"{final}/nodes")
        got = nodes.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("node_id")), "\n"), 256).alias("d")).first()
        if (got["n"], got["d"]) != (manifest["node_count"], manifest["node_ids_sha256"]):
            raise ValueError("the nodes are not those of the manifest")
        self._verified.add((final, manifest_sha256))
        return manifest

    def load(self, guideline_id: str, version_id: str, manifest_sha256: str) -> DataFrame:
        self.verify(guideline_id, version_id, manifest_sha256)
        return self.spark.read.parquet(f"{self.path(guideline_id, version_id)}/nodes")
