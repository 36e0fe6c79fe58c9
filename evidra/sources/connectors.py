"""Connectors to services and libraries that are not part of Spark: encoders, table OCR, PDF readers.

Each takes its transport as a parameter, so that tests and offline runs plug in their own. On data they run in
``mapInPandas``, a batch at a time.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

Transport = Callable[[str, dict[str, str], bytes, float], tuple[int, bytes]]
RETRIED = {408, 429}


class HashingEncoder:
    """A deterministic offline encoder: signed hashed character trigrams, normalised to length 1."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimension)
            low = f" {text.casefold()} "
            for i in range(len(low) - 2):
                h = int.from_bytes(hashlib.blake2b(low[i : i + 3].encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1 if h >> 63 else -1
            norm = math.sqrt(float(v @ v))
            out.append((v / norm if norm else v).tolist())
        return out


@dataclass
class RemoteEncoder:
    """A batch embedding endpoint: one POST for a batch, retried at once on 408, 429, 5xx and lost connections."""

    url: str
    model: str
    dimension: int
    transport: Transport
    api_key: str = field(default="", repr=False)
    timeout: float = 30.0
    max_retries: int = 2

    def __post_init__(self) -> None:
        parts = urlsplit(self.url)
        if parts.scheme != "https" and parts.hostname not in ("localhost", "127.0.0.1", "::1"):
            raise ValueError("an encoder that is not on this machine needs https")

    def encode(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        body = json.dumps({"model": self.model, "input": texts}).encode()
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"}
        for attempt in range(self.max_retries + 1):
            try:
                status, answer = self.transport(self.url, headers, body, self.timeout)
            except OSError:
                status, answer = 0, b""
            if status == 200:
                return self._vectors(answer, len(texts))
            if attempt == self.max_retries or not (status in RETRIED or status >= 500 or status == 0):
                break
        raise RuntimeError(f"the encoder failed with status {status}")

    def _vectors(self, answer: bytes, n: int) -> list[list[float]]:
        try:
            rows = json.loads(answer)["data"]
            by_index = {r["index"]: r["embedding"] for r in rows}
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError("the encoder's answer is malformed") from e
        if len(rows) != n or set(by_index) != set(range(n)):
            raise ValueError("the encoder's answer does not have one vector for each text")
        for v in by_index.values():
            if len(v) != self.dimension or not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in v):
                raise ValueError("the encoder's answer has a vector of a wrong size or kind")
        return [[float(x) for x in by_index[i]] for i in range(n)]


def encode_column(df: DataFrame, encoder: HashingEncoder | RemoteEncoder, text: str = "text", out: str = "embedding", batch: int = 64) -> DataFrame:
    """``df`` with the vector of each text."""
    schema = StructType([f for f in df.schema if f.name != out] + [StructField(out, ArrayType(FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf[text].fillna("").tolist()
            vectors: list[list[float]] = []
            for at in range(0, len(texts), batch):
                vectors += encoder.encode(texts[at : at + batch])
            yield pdf.assign(**{out: vectors})[schema.names]

    return df.mapInPandas(run, schema)


@dataclass
class TableOcrClient:
    """A table OCR service behind a signed POST: at most three attempts, 1, 2, 4 s apart, after 5xx and lost connections only."""

    host: str
    service: str
    action: str
    version: str
    region: str
    secret_id: str
    secret_key: str = field(repr=False)
    transport: Transport = field(repr=False)
    attempts: int = 3
    timeout: float = 120.0
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)
    clock: Callable[[], float] = field(default=time.time, repr=False)

    def headers(self, body: bytes, timestamp: int) -> dict[str, str]:
        """Headers with the TC3-HMAC-SHA256 signature of the body."""
        day = datetime.fromtimestamp(timestamp, UTC).strftime("%Y-%m-%d")
        kind = "application/json; charset=utf-8"
        request = "\n".join(["POST", "/", "", f"content-type:{kind}\nhost:{self.host}\n", "content-type;host", hashlib.sha256(body).hexdigest()])
        scope = f"{day}/{self.service}/tc3_request"
        to_sign = "\n".join(["TC3-HMAC-SHA256", str(timestamp), scope, hashlib.sha256(request.encode()).hexdigest()])
        key = b"TC3" + self.secret_key.encode()
        for part in (day, self.service, "tc3_request"):
            key = hmac.new(key, part.encode(), hashlib.sha256).digest()
        signature = hmac.new(key, to_sign.encode(), hashlib.sha256).hexdigest()
        return {
            "Authorization": f"TC3-HMAC-SHA256 Credential={self.secret_id}/{scope}, SignedHeaders=content-type;host, Signature={signature}",
            "Content-Type": kind,
            "Host": self.host,
            "X-TC-Action": self.action,
            "X-TC-Timestamp": str(timestamp),
            "X-TC-Version": self.version,
            "X-TC-Region": self.region,
        }

    def recognise(self, png: bytes) -> dict[str, object]:
        import base64

        body = json.dumps({"ImageBase64": base64.b64encode(png).decode()}).encode()
        for attempt in range(self.attempts):
            if attempt:
                self.sleep(2.0 ** (attempt - 1))
            try:
                status, answer = self.transport(f"https://{self.host}/", self.headers(body, int(self.clock())), body, self.timeout)
            except OSError:
                continue
            if status >= 500:
                continue
            if status != 200:
                raise RuntimeError(f"table OCR failed with status {status}")
            payload = json.loads(answer)
            if not isinstance(payload, dict) or not isinstance(response := payload.get("Response"), dict):
                raise ValueError("table OCR gave no Response object")
            if "Error" in response:
                raise RuntimeError(f"table OCR error {response['Error'].get('Code', '')}")
            return payload
        raise RuntimeError("table OCR gave no answer")


def recognise_pages(pages: DataFrame, client: TableOcrClient) -> DataFrame:
    """(page, payload): OCR answers as JSON for rows of (page, png). Rows with an answer already are the caller's to leave out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"page": pdf["page"], "payload": [json.dumps(client.recognise(p), ensure_ascii=False) for p in pdf["png"]]})

    return pages.select("page", "png").mapInPandas(run, "page int, payload string")


#: A PDF reader for ``discover_tables``: bytes and page indexes to (page index, boxes as x0, y0, x1, y1).
PdfReader = Callable[[bytes, list[int]], Iterator[tuple[int, list[tuple[float, float, float, float]]]]]


def discover_tables(files: DataFrame, wanted: DataFrame, reader: PdfReader) -> DataFrame:
    """Table boxes of the pages that are known to have tables, in reading order, with the boxes of the page image at twice the scale.

    ``files`` has (path, content), ``wanted`` (path, page_index, expected). Fewer boxes than expected is an error; of more, the largest stay.
    """
    from pyspark.sql import functions as F

    pages = wanted.groupBy("path").agg(F.collect_list(F.struct("page_index", "expected")).alias("pages"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, row in pdf.iterrows():
                expected = {int(p["page_index"]): int(p["expected"]) for p in row["pages"]}
                for index, boxes in reader(bytes(row["content"]), sorted(expected)):
                    if len(boxes) < expected[index]:
                        raise ValueError(f"page {index + 1} has {len(boxes)} tables, {expected[index]} are expected")
                    most = sorted(boxes, key=lambda b: -(b[2] - b[0]) * (b[3] - b[1]))[: expected[index]]
                    most.sort(key=lambda b: (b[1], b[0]))
                    yield pd.DataFrame(
                        {
                            "path": row["path"], "page_index": index, "page_number": index + 1, "ord": range(1, len(most) + 1),
                            **{k: [float(b[i]) for b in most] for i, k in enumerate(("x0", "y0", "x1", "y1"))},
                            **{"s" + k: [2.0 * b[i] for b in most] for i, k in enumerate(("x0", "y0", "x1", "y1"))},
                        }
                    )

    schema = "path string, page_index int, page_number int, ord int, x0 double, y0 double, x1 double, y1 double, sx0 double, sy0 double, sx1 double, sy1 double"
    return files.join(pages, "path").select("path", "content", "pages").mapInPandas(run, schema)
