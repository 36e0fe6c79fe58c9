"""The facade: ingest, approve, search, guidelines, diff and audit over one registry, snapshot store and encoder.

Sources are checked before a draft exists. Each step of an ingest is a commit of its own; a failure leaves the draft and
an ``ingest_failed`` audit row, and is raised.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions.nodes import build_nodes, indexable, metadata_json
from .operators import diff, retrieval, terminology
from .operators.registry import Registry
from .operators.snapshot import SnapshotStore, safe_name
from .sources.connectors import encode_column
from .sources.jsonl import locator_json, read_chunks


@dataclass(frozen=True)
class SourceInput:
    id: str
    path: str
    kind: str
    provenance: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class IngestRequest:
    guideline_id: str
    title: str
    language: str
    authority_level: str
    version_id: str
    version_label: str
    chunks: SourceInput
    citation: SourceInput
    published_at: str | None = None
    title_zh: str | None = None
    publisher: str | None = None


@dataclass(frozen=True)
class GlossarySource:
    """Where a base's glossary comes from: the active versions of some guidelines, with seeds and reviewed pairs (english, chinese)."""

    path: str
    guideline_ids: tuple[str, ...]
    seeds: DataFrame
    reviewed: DataFrame


class EvidenceBase:
    def __init__(self, spark: SparkSession, registry_root: str, snapshot_root: str, managed_root: str, encoder: object, profile: dict, glossary: Mapping[str, Sequence[str]] | GlossarySource | None = None) -> None:
        self.spark, self.encoder, self.glossary = spark, encoder, glossary or {}
        self._mined: tuple[tuple[str, ...], Mapping[str, Sequence[str]]] | None = None
        self.registry = Registry(spark, registry_root)
        self.snapshots = SnapshotStore(spark, snapshot_root, profile)
        self.managed_root = managed_root.rstrip("/")

    # Ingest

    def _check(self, r: IngestRequest) -> None:
        for name in (r.guideline_id, r.version_id, r.chunks.id, r.citation.id):
            safe_name(name)
        if r.authority_level not in schema.AUTHORITY_LEVELS:
            raise ValueError("unknown authority level")
        if r.chunks.kind != "jsonl" or r.citation.kind not in ("pdf", "html"):
            raise ValueError("chunks must be jsonl and the citation a pdf or html file")
        if r.chunks.id == r.citation.id or r.chunks.path == r.citation.path:
            raise ValueError("the sources must differ")
        for s in (r.chunks, r.citation):
            if not os.path.isabs(s.path) or not os.path.isfile(s.path):
                raise FileNotFoundError(f"source {s.path} must be an absolute path of a file")
        known = self.registry.table("guideline").where(F.col("id") == r.guideline_id).limit(1).collect()
        if known and (known[0]["language"], known[0]["authority_level"]) != (r.language, r.authority_level):
            raise ValueError("the guideline is registered with another language or authority level")
        if not known and not r.title.strip():
            raise ValueError("a new guideline needs a title")

    def _copy(self, r: IngestRequest, s: SourceInput, actor: str) -> str:
        folder = os.path.join(self.managed_root, r.guideline_id, r.version_id)
        target = os.path.join(folder, f"{s.id}{os.path.splitext(s.path)[1]}")
        if os.path.exists(target):
            raise FileExistsError(f"managed file {target} exists")
        os.makedirs(folder, exist_ok=True)
        shutil.copyfile(s.path, target)
        with open(s.path, "rb") as a, open(target, "rb") as b:
            digest, copy = (hashlib.file_digest(f, "sha256").hexdigest() for f in (a, b))
        if digest != copy:
            raise OSError(f"managed file {target} differs from its source")
        self.registry.add_source_file(
            actor, id=s.id, document_version_id=r.version_id, source_kind=s.kind, original_path=s.path, managed_path=target, sha256=digest,
            byte_size=os.path.getsize(target), provenance_json=json.dumps(s.provenance, ensure_ascii=False, sort_keys=True),
        )
        return target

    def ingest(self, r: IngestRequest, actor: str) -> str:
        """A new draft version with its chunks, nodes and snapshot, and its diff to the active version if there is one."""
        self._check(r)
        reg = self.registry
        if reg.table("guideline").where(F.col("id") == r.guideline_id).isEmpty():
            reg.create_guideline(actor, id=r.guideline_id, title=r.title, language=r.language, authority_level=r.authority_level, title_zh=r.title_zh, publisher=r.publisher)
        active = reg.versions().where((F.col("guideline_id") == r.guideline_id) & (F.col("status") == "active")).select("id").limit(1).collect()
        reg.create_draft_version(actor, id=r.version_id, guideline_id=r.guideline_id, version_label=r.version_label, published_at=r.published_at)
        try:
            path = self._copy(r, r.chunks, actor)
            self._copy(r, r.citation, actor)
            records = read_chunks(self.spark, path, r.chunks.id)
            chunks = records.withColumn("locator_json", locator_json(F.col("present"), F.col("v")))
            reg.add_raw_chunks(actor, chunks.select(*schema.RAW_CHUNK.names))
            nodes = self._nodes(r, records)
            reg.add_node_manifest(actor, nodes.select(*schema.NODE.names))
            encoded = encode_column(nodes, self.encoder)
            folder, digest = self.snapshots.build(r.guideline_id, r.version_id, encoded)
            reg.set_draft_snapshot(actor, r.version_id, folder, digest)
            if active:
                rows = diff.compare(reg.version_chunks(active[0]["id"]), reg.version_chunks(r.version_id), active[0]["id"], r.version_id)
                reg.replace_version_diffs(actor, rows)
            reg.record_audit(actor, "ingest_succeeded", "document_version", r.version_id)
        except Exception as e:
            reg.record_audit(actor, "ingest_failed", "document_version", r.version_id, {"error": type(e).__name__})
            raise
        return r.version_id

    def _nodes(self, r: IngestRequest, records: DataFrame) -> DataFrame:
        v = F.col("v")
        fields = {f.name: F.try_variant_get(v, f"$.{f.name}", f.dataType.simpleString()) for f in schema.CHUNK if f.name not in ("chunk_id", "text")}
        fields |= {"retrieval_role": F.try_variant_get(v, "$.retrieval_role", "string")}
        said = F.try_variant_get(v, "$.indexable", "string")
        own = {
            "guideline_id": F.lit(r.guideline_id), "version_id": F.lit(r.version_id), "raw_chunk_id": F.col("id"), "chunk_id": F.col("chunk_id"), "source_kind": F.lit(r.citation.kind),
            "authority_level": F.lit(r.authority_level), "language": F.lit(r.language), "source_ordinal": F.col("source_ordinal"), "content_sha256": F.col("content_sha256"), "source_file_id": F.lit(r.citation.id),
        }
        flag = indexable(F.col("text"), fields["block_type"], fields["section_path"], fields["retrieval_role"], fields["page_start"], said)
        flat = records.select(
            *(c.alias(k) for k, c in {**fields, **own}.items() if k != "content_sha256"), "text", flag.alias("indexable"),
            metadata_json({**{k: c for k, c in fields.items() if k != "retrieval_role"}, **own}, F.col("present")).alias("metadata_json"),
        )
        return build_nodes(flat).withColumn("document_version_id", F.lit(r.version_id))

    def approve(self, version_id: str, actor: str) -> None:
        """Verify the draft's snapshot, then make it the active version; a failure is audited and raised."""
        v = self.registry.get("version", version_id)
        try:
            if not v["snapshot_path"]:
                raise ValueError("a version without a snapshot can't be approved")
            self.snapshots.load(v["guideline_id"], version_id, v["snapshot_manifest_sha256"]).limit(1).collect()
            self.registry.approve_version(actor, version_id)
        except Exception as e:
            self.registry.record_audit(actor, "approval_failed", "document_version", version_id, {"error": str(e)[:200]})
            raise

    # Reads

    def search(self, request: retrieval.SearchRequest) -> retrieval.SearchResponse:
        versions = self.registry.versions()
        resolved = retrieval.resolve_versions(versions, self.registry.table("guideline"), request)
        found = {r["id"]: r for r in versions.where(F.col("id").isin([v for v, _ in resolved])).collect()}
        nodes = None
        for version, guideline in resolved:
            one = self.snapshots.load(guideline, version, found[version]["snapshot_manifest_sha256"])
            nodes = one if nodes is None else nodes.unionByName(one)
        if nodes is None:
            raise ValueError("no version to search")
        return retrieval.search(nodes, resolved, request, self.encoder, self.terms())

    def terms(self) -> Mapping[str, Sequence[str]]:
        """The glossary that searches use. A mined one is kept while its active versions stay the same; if it can't be read or mined, the seeds are used."""
        source = self.glossary
        if not isinstance(source, GlossarySource):
            return source
        active = self.registry.versions().where((F.col("status") == "active") & F.col("guideline_id").isin(list(source.guideline_ids)))
        ids = tuple(sorted(r["id"] for r in active.select("id").collect()))
        if self._mined and self._mined[0] == ids and self._mined[1]:
            return self._mined[1]
        chunks = self.registry.table("raw_chunk").limit(0)
        for v in ids:
            chunks = chunks.unionByName(self.registry.version_chunks(v).select(*schema.RAW_CHUNK.names))
        try:
            found = terminology.load_or_mine(self.spark, source.path, chunks, ids, source.seeds, source.reviewed)
        except (OSError, ValueError, TypeError, PySparkException) as e:
            warnings.warn(f"the glossary can't be built, seeds are used: {e}", stacklevel=2)
            found = terminology.seed_terms(source.seeds)
        self._mined = ids, found
        return found

    def guidelines(self) -> DataFrame:
        return self.registry.guideline_listing()

    def diff(self, version_id: str, prior_version_id: str) -> DataFrame:
        for v in (version_id, prior_version_id):
            self.registry.get("version", v)
        return self.registry.list_version_diffs(prior_version_id, version_id)

    def audit(self) -> DataFrame:
        return self.registry.list_audit()

    def snapshot_info(self, version_id: str) -> dict[str, object]:
        v = self.registry.get("version", version_id)
        return self.snapshots.verify(v["guideline_id"], version_id, v["snapshot_manifest_sha256"], v["snapshot_path"])
