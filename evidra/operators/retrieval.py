"""Version-scoped retrieval: cosine and BM25 rankings, their fusion, concept filter and guideline coverage.

Every ranking is one plan partitioned by version: scores are Column expressions over the node scan, the best of each
version are kept by a window whose limit Spark applies before the shuffle, and only those rows meet again.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.nodes import citation, indexable
from . import terminology

# They decide scores, and must stay as they are.
BM25_K1, BM25_B, RRF_K = 1.5, 0.75, 60
BROADCAST_ROWS = 1_000_000
MOST_RESULTS, WIDENED_BY, WIDENED_LEAST = 100, 10, 50


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine to a literal query vector; null where a norm is zero."""
    q = F.array(*(F.lit(float(v)) for v in query))
    norm = math.sqrt(sum(v * v for v in query))
    return F.when(F.lit(norm) > 0, dot(vector, q) / F.nullif(F.sqrt(dot(vector, vector)), F.lit(0.0)) / F.lit(norm or 1.0))


def best_of_each(scored: DataFrame, k: int, by: Sequence[str] = ("version_id",), score: str = "score", tie: str = "node_id") -> DataFrame:
    """The k best rows of each group with their rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_ranking(nodes: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """(version_id, node_id, score, rank) of the nearest nodes of each version."""
    scored = nodes.select("version_id", "node_id", cosine(F.col("embedding"), query).alias("score")).where("score is not null")
    return best_of_each(scored, k)


def _times(bag: Column, term: str) -> Column:
    return F.size(F.filter(bag, lambda t: t == F.lit(term)))


def bm25_scores(nodes: DataFrame, query_tokens: Sequence[str], text: str = "text", by: str = "version_id", key: str = "node_id") -> DataFrame:
    """(by, key, score): BM25 of a query over the corpus that each version is; positive scores only.

    The corpus are the nodes with at least one token. Term counts are taken from each node's token array, so nothing is
    exploded and only one row of statistics for each version moves. A token that the query repeats adds again.
    """
    wanted = Counter(query_tokens)
    terms = sorted(wanted)

    def counts(bag: Column) -> Column:
        one = F.struct(F.size(bag).alias("dl"), *(_times(bag, w).alias(f"tf{i}") for i, w in enumerate(terms)))
        return F.filter(F.array(one), lambda c: c["dl"] > 0)

    # Exploding the one-row array keeps filters above it: pushed below, they would each find the tokens again.
    counted = nodes.select(by, key, F.explode(T.let(T.tokens(F.col(text)), counts)).alias("c")).select(by, key, "c.*")
    if not terms:
        return counted.select(by, key, F.lit(0.0).alias("score")).limit(0)
    stats = counted.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))
    )
    some = F.greatest(*(F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0
    score = sum(
        (
            F.lit(float(wanted[w]))
            * F.log(F.lit(1.0) + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
            * F.col(f"tf{i}")
            / (F.col(f"tf{i}") + F.lit(BM25_K1) * (F.lit(1.0 - BM25_B) + F.lit(BM25_B) * F.col("dl") / F.col("avgdl")))
            for i, w in enumerate(terms)
        ),
        F.lit(0.0),
    )
    # One row for each version: Spark broadcasts them where their size allows.
    return positive(counted.where(some).join(stats, by).select(by, key, score.alias("score")))


def positive(scored: DataFrame, score: str = "score") -> DataFrame:
    """Rows whose score is there, finite and above 0."""
    s = F.col(score)
    return scored.where(s.isNotNull() & ~F.isnan(s) & (s > 0) & (s < float("inf")))


def bm25_ranking(nodes: DataFrame, query: str, k: int) -> DataFrame:
    return best_of_each(bm25_scores(nodes, terminology.tokenize(query)), k)


def build_inverted_index(nodes: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings (version_id, token, node_id, tf, dl) and statistics (version_id, n, avgdl), to be written once for a snapshot."""
    whole = F.explode(T.let(T.tokens(F.col(text)), lambda b: F.filter(F.array(F.struct(F.size(b).alias("dl"), b.alias("bag"))), lambda c: c["dl"] > 0)))
    bags = nodes.select("version_id", "node_id", whole.alias("c")).select("version_id", "node_id", "c.*")
    postings = bags.select("version_id", "node_id", "dl", F.explode("bag").alias("token")).groupBy("version_id", "token", "node_id", "dl").agg(
        F.count(F.lit(1)).alias("tf")
    )
    return postings, bags.groupBy("version_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def token_stats(postings: DataFrame) -> DataFrame:
    """(token, tf, df) over all versions of an index."""
    return postings.groupBy("token").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def node_token_stats(nodes: DataFrame, text: str = "text") -> DataFrame:
    """(token, tf, df) of nodes, as ``token_stats`` has it of their postings, which are made for repeated nodes only.

    A node that is one row gives its sorted tokens, each marked where it stands first, so that tokens are counted before they move. A token of a
    node without id counts in tf alone.
    """
    key = ["version_id", "node_id"]
    repeated = nodes.where("node_id is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    some = repeated.limit(BROADCAST_ROWS + 1).count()

    def marked(bag: Column) -> Column:
        return F.transform(bag, lambda t, i: F.struct(t.alias("token"), ((i == 0) | ~t.eqNullSafe(F.get(bag, i - 1))).cast("int").alias("df")))

    def counted(rows: DataFrame) -> DataFrame:
        each = rows.select("node_id", F.explode(T.let(F.sort_array(T.tokens(F.col(text))), marked)).alias("t")).select("node_id", "t.*")
        return each.groupBy("token").agg(F.count(F.lit(1)).alias("tf"), F.sum(F.when(F.col("node_id").isNotNull(), F.col("df")).otherwise(0)).alias("df"))

    if not some:
        return counted(nodes)
    repeated = F.broadcast(repeated) if some <= BROADCAST_ROWS else repeated
    postings = nodes.join(repeated, key, "left_semi").select(*key, F.explode(T.tokens(F.col(text))).alias("token")).groupBy(*key, "token").agg(F.count(F.lit(1)).alias("tf"))
    parts = counted(nodes.join(repeated, key, "left_anti")).unionByName(token_stats(postings))
    return parts.groupBy("token").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def bm25_batch(postings: DataFrame, stats: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, version_id, node_id, score, rank) for a table of (query_id, token), repeated tokens repeated."""
    asked = queries.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    hits = postings.join(asked, "token")
    df = postings.join(asked.select("token").distinct(), "token", "left_semi").groupBy("version_id", "token").agg(F.count(F.lit(1)).alias("df"))
    part = (
        F.col("times")
        * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        * F.col("tf")
        / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    )
    scored = hits.join(df, ["version_id", "token"]).join(stats, "version_id").groupBy("query_id", "version_id", "node_id").agg(F.sum(part).alias("score"))
    return best_of_each(positive(scored), k, ("query_id", "version_id"))


def rrf(rankings: Sequence[DataFrame], k: int = RRF_K, by: Sequence[str] = ("version_id",)) -> DataFrame:
    """Reciprocal rank fusion: each node's sum of 1 / (k + rank) over the rankings, its best rank counting in each."""
    if k <= 0:
        raise ValueError("k must be positive")
    parts = [r.groupBy(*by, "node_id").agg(F.min("rank").alias("rank")) for r in rankings]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*by, "node_id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))


def with_coverage(ranked: DataFrame, guidelines: Sequence[str], top_k: int) -> DataFrame:
    """The first top_k rows, but each guideline's best row first, in the order of ``guidelines``, where all of them have room.

    ``ranked`` has guideline_id, node_id and score; the result has its place in ``position``, from 1.
    """
    order = [g for i, g in enumerate(guidelines) if g not in guidelines[:i]]
    tier = F.lit(1)
    place = F.lit(0)
    if top_k >= len(order) and order:
        best = F.row_number().over(Window.partitionBy("guideline_id").orderBy(F.desc("score"), "node_id")) == 1
        at = F.array_position(F.array(*map(F.lit, order)), F.col("guideline_id"))
        tier = F.when(best & (at > 0), 0).otherwise(1)
        place = F.when(best & (at > 0), at).otherwise(0)
    tiered = ranked.withColumn("_tier", tier).withColumn("_place", place)
    first = tiered.orderBy("_tier", "_place", F.desc("score"), "node_id").limit(top_k)
    position = F.row_number().over(Window.orderBy("_tier", "_place", F.desc("score"), "node_id"))  # over top_k rows only
    return first.withColumn("position", position).drop("_tier", "_place")


@dataclass(frozen=True)
class SearchRequest:
    query: str
    guideline_ids: tuple[str, ...] = ()
    version_ids: tuple[str, ...] = ()
    language: str | None = None
    top_k: int = 5
    use_bm25: bool = False


@dataclass
class SearchResponse:
    evidence: DataFrame
    resolved_version_ids: list[str]
    retrieval_modes: list[str] = field(default_factory=lambda: ["vector"])


def wanted_versions(versions: DataFrame, guidelines: DataFrame, request: SearchRequest) -> DataFrame:
    """(id, guideline_id, status, language): the versions that a request names, or the active ones of its guidelines."""
    wanted = versions.where(F.col("id").isin(list(request.version_ids))) if request.version_ids else versions.where("status = 'active'")
    if not request.version_ids and request.guideline_ids:
        wanted = wanted.where(F.col("guideline_id").isin(list(request.guideline_ids)))
    languages = guidelines.select(F.col("id").alias("guideline_id"), "language")
    return wanted.select("id", "guideline_id", "status").join(languages, "guideline_id", "left")


def resolve_versions(versions: DataFrame, guidelines: DataFrame, request: SearchRequest) -> list[tuple[str, str]]:
    """(version id, guideline id) of the versions to search, by version id; the request is checked first.

    Without explicit versions the active ones are meant. An explicit version may be superseded or archived but not a draft, must
    exist, and must belong to the guidelines asked for.
    """
    if not request.query.strip():
        raise ValueError("query must not be blank")
    if not 1 <= request.top_k <= MOST_RESULTS:
        raise ValueError(f"top_k must be between 1 and {MOST_RESULTS}")
    for name, ids in (("guideline_ids", request.guideline_ids), ("version_ids", request.version_ids)):
        if len(set(ids)) != len(ids):
            raise ValueError(f"{name} must be unique")
    found = {r["id"]: r for r in wanted_versions(versions, guidelines, request).collect()}
    for v in request.version_ids:
        if v not in found:
            raise KeyError(f"unknown version {v}")
        if found[v]["status"] == "draft":
            raise ValueError(f"version {v} is a draft")
        if request.guideline_ids and found[v]["guideline_id"] not in request.guideline_ids:
            raise ValueError(f"version {v} does not belong to the guidelines asked for")
    chosen = [r for r in found.values() if request.language is None or r["language"] == request.language]
    return sorted((r["id"], r["guideline_id"]) for r in chosen)


def search(
    nodes: DataFrame,
    resolved: Sequence[tuple[str, str]],
    request: SearchRequest,
    encoder: object,
    glossary: dict[str, Sequence[str]] | None = None,
) -> SearchResponse:
    """Hybrid search over the resolved versions.

    ``nodes`` has node_id, version_id, guideline_id, text, embedding, and the columns of the citation; if it has
    ``indexable`` (computed when it was written) that is used, else the rules are applied in the plan. Filtering on
    literal version ids prunes partitions. The query is expanded before it is encoded; concepts come from the query as asked.
    """
    glossary = glossary or {}
    expanded = terminology.expand_query(request.query, glossary)
    groups = terminology.concept_groups(request.query, glossary)
    k = max(request.top_k * WIDENED_BY, WIDENED_LEAST) if len(groups) > 1 else request.top_k
    searched = nodes.where(F.col("version_id").isin([v for v, _ in resolved]))
    flag = F.col("indexable") if "indexable" in nodes.columns else indexable(*(F.col(c) for c in ("text", "block_type", "section_path", "retrieval_role", "page_start")))
    searched = searched.where(flag)
    vector = vector_ranking(searched, encoder.encode([expanded])[0], k)
    merged = rrf([vector, bm25_ranking(searched, expanded, k)]) if request.use_bm25 else vector.select("version_id", "node_id", "score")
    # At most 2 k rows of each version; broadcast only where that is small for the versions searched.
    few = len(resolved) * 2 * k <= BROADCAST_ROWS
    rows = searched.join(F.broadcast(merged) if few else merged, ["version_id", "node_id"])
    if len(groups) > 1:
        rows = rows.where(T.matches_concepts(F.col("text"), groups))
    final = with_coverage(rows, [g for _, g in resolved], request.top_k)
    fields = {c: F.col(c) for c in ("doc_title", "guideline_id", "version_id", "source_kind", "page_start", "page_end", "parent_h1", "section_path", "authority_level", "source_ordinal", "raw_chunk_id")}
    evidence = final.select("position", "node_id", "raw_chunk_id", "text", "score", "guideline_id", "version_id", "language", "authority_level", citation(fields).alias("citation"))
    return SearchResponse(evidence.orderBy("position"), [v for v, _ in resolved], ["vector", "bm25"] if request.use_bm25 else ["vector"])
