"""Bilingual terms: query rewriting on the driver (one query at a time), glossary mining as a plan over chunks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ASCII_TOKEN, CJK_RUN, fold

# They decide which terms are found and rejected, and must stay as they are.
STOP_WORDS = {"and", "or", "with", "without", "of", "the", "a", "an", "in", "for", "to", "on"}
CONNECTORS = {"and", "or", "with", "without"}
GROUP_PUNCTUATION = "，,;；。:："
NODE_TERM = "淋巴转移"
NODE_TERM_VARIANTS = ["淋巴结转移", "腋窝淋巴结转移", "区域淋巴结转移", "淋巴结阳性", "腋窝淋巴结阳性"]
SHORT_ALIAS = "[A-Z0-9][A-Z0-9-]{1,3}"
UNIT = r"(?i)^(?:mmol|mol|mg|mcg|ug|g|kg|ml|l|cm|mm|hz|khz|mhz)(?:/[a-z]+)?(?:\^?[23]|[²³])?$"
IDENTIFIER = r"(?i)(?:^|\b)(?:orcid|nct\d+|www\.|https?://)"
COMPARISON = r"(?i)[<>=≤≥%]|\d+(?:\.\d+)?\s*(?:mmol|mol|mg|mcg|ug|g|kg|ml|l|cm|mm)(?:/[a-z]+)?"
CLAUSE_STARTS = ["如果", "依据", "同时", "包括", "其中", "对于", "通过", "建议", "推荐", "必要时", "目前", "主要", "和", "及", "或", "如", "由"]
CONTEXT_WORDS = [
    "包括", "参考", "参照", "建议", "推荐", "考虑", "此外", "其次", "一般", "依据", "同时", "目前", "需要", "结果按照", "可显著", "可选择", "须在", "本指南",
]
GENERIC_LABELS = ["个月", "分期", "推荐", "可选", "阳性", "阴性", "风险", "治疗", "抑制剂", "患者"]
PATIENTS = "患者"
ZH_THEN_EN = r"([㐀-鿿][㐀-鿿A-Za-z0-9·\-]{1,24})\s*[（(]\s*([^（）()]{2,100})[）)]"
EN_THEN_ZH = r"([A-Za-z][A-Za-z0-9 .+/_\-]{1,79})\s*[（(]\s*([㐀-鿿]{2,24})[）)]"
TERM_EDGES = " \t\r\n:：;；,，"
CACHE_VERSION = 3


def has_cjk(text: str) -> bool:
    return re.search(CJK_RUN, text) is not None


def tokenize(text: str) -> list[str]:
    """Tokens in the order of their runs: CJK bigrams and trigrams (a single sign stays), ASCII terms case-folded."""
    out: list[str] = []
    for m in re.finditer(f"({CJK_RUN})|({ASCII_TOKEN})", text):
        run = m[1]
        if run is None:
            out.append(m[2].casefold())
        elif len(run) == 1:
            out.append(run)
        else:
            out += [run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)]
    return out


def _squeezed(value: object) -> str:
    return " ".join(str(value).split())


def _ambiguous(term: str, glossary: Mapping[str, Sequence[str]]) -> bool:
    """A short ASCII alias of several CJK terms says nothing about which is meant."""
    if has_cjk(term) or not re.fullmatch(SHORT_ALIAS, term, re.I):
        return False
    return len({t for t in glossary.get(term, ()) if isinstance(t, str) and has_cjk(t)}) > 1


def term_matches(query: str, glossary: Mapping[str, Sequence[str]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of glossary terms in the query, the longest first where they overlap, in query order."""
    low = query.casefold()
    spans = []
    for term in glossary:
        if not term.strip() or _ambiguous(term, glossary):
            continue
        bare = re.escape(term.casefold())
        pattern = bare if has_cjk(term) else f"(?<![A-Za-z0-9]){bare}(?![A-Za-z0-9])"
        spans += [(m.start(), m.end(), term) for m in re.finditer(pattern, low)]
    spans.sort(key=lambda s: (s[0] - s[1], s[0], s[2].casefold(), s[2]))
    taken: list[tuple[int, int, str]] = []
    for s in spans:
        if all(s[1] <= t[0] or t[1] <= s[0] for t in taken):
            taken.append(s)
    return sorted(taken, key=lambda s: (s[0], s[0] - s[1], s[2].casefold()))


def expand_query(query: str, glossary: Mapping[str, Sequence[str]]) -> str:
    """The query, and after it the aliases of its terms that it doesn't have yet."""
    whole = _squeezed(query)
    if not whole:
        return whole
    parts = {whole.casefold(): whole}
    for _, _, term in term_matches(whole, glossary):
        for alias in map(_squeezed, glossary[term]):
            if alias:
                parts.setdefault(alias.casefold(), alias)
    return " ".join(parts.values())


def concept_groups(query: str, glossary: Mapping[str, Sequence[str]]) -> list[list[str]]:
    """The concepts of a query, each with its variants, in query order.

    Glossary terms are concepts; of the rest each CJK word of two signs or more is one, and so is each run of ASCII words,
    which ends at a connector, at punctuation, at a glossary term and at anything else. Stop words count only inside a run.
    """
    whole = _squeezed(query)
    matches = term_matches(whole, glossary)
    groups: list[tuple[int, list[str]]] = []
    for start, _, term in matches:
        variants = [term, *glossary[term], *(NODE_TERM_VARIANTS if term == NODE_TERM else ())]
        groups.append((start, list(dict.fromkeys(v for v in map(_squeezed, variants) if v))))
    run: list[str] = []
    run_start = 0

    def close() -> None:
        if run:
            groups.append((run_start, [" ".join(run)]))
            run.clear()

    for m in re.finditer(r"\S+", whole):
        if any(m.start() < e and s < m.end() for s, e, _ in matches):
            close()
            continue
        word = m[0].strip(GROUP_PUNCTUATION)
        if m[0][0] in GROUP_PUNCTUATION:
            close()
        low = word.casefold()
        ascii_word = re.fullmatch(ASCII_TOKEN, word) is not None
        if low in CONNECTORS:
            close()
            continue
        if has_cjk(word):
            close()
            if len(word) >= 2:
                groups.append((m.start(), [word]))
        elif ascii_word and (run or low not in STOP_WORDS):
            if not run:
                run_start = m.start()
            run.append(word)
        else:
            close()
        if m[0][-1] in GROUP_PUNCTUATION:
            close()
    close()
    return [g for _, g in sorted(groups, key=lambda g: g[0])]


def clean_term(term: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(term, F.lit(TERM_EDGES)), r"(?U)\s+", " "))


def _any(column: Column, values: Sequence[str], how: str) -> Column:
    return reduce(lambda a, b: a | b, [getattr(column, how)(v) for v in values])


def english_reason(term: Column, least_letters: int = 3) -> Column:
    """Why an English term is rejected; null if it is not."""
    return (
        F.when(term.rlike(IDENTIFIER), "identifier")
        .when(term.rlike(UNIT) | term.rlike(COMPARISON), "measurement_or_threshold")
        .when((F.char_length(term) > 80) | ~term.rlike("^[A-Za-z]"), "invalid_term_shape")
        .when(F.regexp_count(term, F.lit("[A-Za-z]")) < least_letters, "invalid_term_shape")
        .when(term.rlike(CJK_RUN), "invalid_term_shape")
    )


def chinese_reason(term: Column) -> Column:
    """Why a Chinese term is rejected; null if it is not."""
    return (
        F.when(term.isin(GENERIC_LABELS) | _any(term, CLAUSE_STARTS, "startswith"), "sentence_fragment")
        .when(_any(term, CONTEXT_WORDS, "contains") | term.endswith(PATIENTS), "sentence_fragment")
        .when(~F.char_length(term).between(2, 16), "invalid_term_shape")
        .when(term.rlike("[，。；：,.;:（）()]") | term.rlike("[A-Za-z]") | ~term.rlike(CJK_RUN), "invalid_term_shape")
    )


def seed_reason(english: Column, chinese: Column, trusted: Column) -> Column:
    """Why a seed pair is rejected. A trusted pair may be longer, and its Chinese side may have letters."""
    relaxed = F.coalesce(
        F.when(english.rlike(UNIT), "measurement_or_threshold")
        .when(english.rlike(IDENTIFIER), "identifier")
        .when(english.rlike(COMPARISON), "measurement_or_threshold")
        .when(~english.rlike("^[A-Za-z]") | english.rlike(CJK_RUN), "invalid_term_shape"),
        F.when(_any(chinese, CONTEXT_WORDS, "contains") | chinese.endswith(PATIENTS), "sentence_fragment").when(
            ~F.char_length(chinese).between(2, 24) | chinese.rlike("[，。；：,.;:（）()]") | ~chinese.rlike(CJK_RUN), "invalid_term_shape"
        ),
    )
    return F.when(trusted, relaxed).otherwise(F.coalesce(english_reason(english), chinese_reason(chinese)))


def candidates(chunks: DataFrame) -> DataFrame:
    """(chunk_id, english, chinese) of all bracketed pairs: a Chinese term with English aliases, or the other way."""
    text = F.col("text")
    zh = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(ZH_THEN_EN), 1).alias("zh"), F.regexp_extract_all(text, F.lit(ZH_THEN_EN), 2).alias("inside")
    )
    en = F.arrays_zip(F.regexp_extract_all(text, F.lit(EN_THEN_ZH), 1).alias("en"), F.regexp_extract_all(text, F.lit(EN_THEN_ZH), 2).alias("zh"))
    some = chunks.where(text.rlike("[（(]")).select("chunk_id", "text")
    a = some.select("chunk_id", F.explode(zh).alias("m")).select("chunk_id", F.explode(F.split("m.inside", "[，,;；]")).alias("en"), F.col("m.zh").alias("zh"))
    b = some.select("chunk_id", F.explode(en).alias("m")).select("chunk_id", "m.en", "m.zh")
    return a.unionByName(b).select("chunk_id", clean_term(F.col("en")).alias("english"), clean_term(F.col("zh")).alias("chinese")).where("english <> ''")


def ambiguous_terms(pairs: DataFrame) -> DataFrame:
    """(english, targets) of case-folded English terms that have several Chinese ones."""
    return pairs.groupBy(fold(F.col("english")).alias("english")).agg(F.count_distinct("chinese").alias("targets")).where("targets > 1")


def judge(found: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``found`` with the reason of rejection: by shape, then unreviewed, then ambiguous; null for accepted pairs.

    ``reviewed`` has (english, chinese); an English term with several Chinese ones among what is left is ambiguous.
    """
    allow = reviewed.select(fold(F.col("english")).alias("_e"), F.col("chinese").alias("_c")).distinct()
    key = (fold(F.col("english")) == F.col("_e")) & (F.col("chinese") == F.col("_c"))
    shaped = found.withColumn("shape", F.coalesce(english_reason(F.col("english")), chinese_reason(F.col("chinese"))))
    known = shaped.join(allow, key, "left").withColumn(
        "reason", F.when(F.col("shape").isNotNull(), F.col("shape")).when(F.col("_e").isNull(), "unreviewed_candidate")
    )
    many = ambiguous_terms(known.where("reason is null")).select(F.col("english").alias("_k"))
    return (
        known.join(many, fold(F.col("english")) == F.col("_k"), "left")
        .withColumn("reason", F.coalesce("reason", F.when(F.col("_k").isNotNull(), "ambiguous_alias")))
        .select("chunk_id", "english", "chinese", "reason")
    )


def mine_glossary(chunks: DataFrame, seeds: DataFrame, reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The glossary (term, aliases), in both directions, and the distinct rejected candidates (chunk_id, source, target, reason).

    ``seeds`` and ``reviewed`` have (english, chinese). A seed that fails its check is an error.
    """
    trusted = reviewed.select(fold(F.col("english")).alias("_e"), F.col("chinese").alias("_c")).distinct()
    checked = seeds.join(trusted, (fold(F.col("english")) == F.col("_e")) & (F.col("chinese") == F.col("_c")), "left")
    wrong = checked.select("english", "chinese", seed_reason(F.col("english"), F.col("chinese"), F.col("_e").isNotNull()).alias("reason")).where("reason is not null")
    if bad := wrong.limit(1).collect():
        raise ValueError(f"invalid seed mapping ({bad[0]['reason']}): {bad[0]['chinese']!r} -> {bad[0]['english']!r}")
    judged = judge(candidates(chunks), reviewed.select("english", "chinese").unionByName(seeds.select("english", "chinese")))
    pairs = judged.where("reason is null").select("english", "chinese").unionByName(seeds.select("english", "chinese")).distinct()
    rejected = judged.where("reason is not null").select("chunk_id", F.col("english").alias("source"), F.col("chinese").alias("target"), "reason").distinct()
    return group_aliases(pairs), rejected.orderBy("chunk_id", fold(F.col("source")), fold(F.col("target")), "reason")


def group_aliases(pairs: DataFrame) -> DataFrame:
    """(term, aliases): both directions of (english, chinese), aliases in case-folded order."""
    both = pairs.select(F.col("english").alias("term"), F.col("chinese").alias("alias")).unionByName(
        pairs.select(F.col("chinese").alias("term"), F.col("english").alias("alias"))
    )
    kept = both.where((fold(F.col("term")) != fold(F.col("alias"))) & (F.col("term") != "") & (F.col("alias") != ""))
    return kept.groupBy("term").agg(
        F.transform(F.array_sort(F.collect_set(F.struct(fold(F.col("alias")).alias("k"), F.col("alias").alias("a")))), lambda v: v["a"]).alias("aliases")
    )


def pair_counts(glossary: DataFrame) -> DataFrame:
    """One row: directed pairs, and unordered distinct pairs."""
    flat = glossary.select("term", F.explode("aliases").alias("alias"))
    a, b = (F.struct(fold(F.col(c)).alias("k"), F.col(c).alias("v")) for c in ("term", "alias"))
    return flat.agg(F.count(F.lit(1)).alias("directed"), F.count_distinct(F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))).alias("unique"))


def audit(glossary: DataFrame, trusted: DataFrame) -> DataFrame:
    """(error, term, alias) of all faults of a glossary: empty, same on both sides, same language, a rejected side, one-way."""
    flat = glossary.select("term", F.explode_outer("aliases").alias("alias"))
    known = trusted.select(fold(F.col("english")).alias("_e"), F.col("chinese").alias("_c")).distinct()
    zh_first = F.col("term").rlike(CJK_RUN)
    english = F.when(zh_first, F.col("alias")).otherwise(F.col("term"))
    chinese = F.when(zh_first, F.col("term")).otherwise(F.col("alias"))
    sided = flat.withColumn("english", english).withColumn("chinese", chinese).join(
        known, (fold(F.col("english")) == F.col("_e")) & (F.col("chinese") == F.col("_c")), "left"
    )
    own = (
        F.when(F.trim("term") == "", "invalid empty term key")
        .when(F.col("alias").isNull(), "invalid empty term values")
        .when(fold(F.col("term")) == fold(F.col("alias")), "invalid mapping")
        .when(zh_first == F.col("alias").rlike(CJK_RUN), "language-shape")
        .when(english_reason(F.col("english"), 0).isNotNull() | (F.col("_e").isNull() & chinese_reason(F.col("chinese")).isNotNull()), "forbidden mapping")
    )
    faults = sided.select(own.alias("error"), "term", "alias").where("error is not null")
    one_way = _one_way(flat)
    return faults.unionByName(one_way.select(F.lit("non-reciprocal").alias("error"), "term", "alias")).distinct()


def _one_way(flat: DataFrame) -> DataFrame:
    """Pairs whose alias does not lead back to the term, but for case."""
    back = flat.select(F.col("term").alias("_from"), fold(F.col("alias")).alias("_to"))
    some = flat.where("alias is not null")
    return some.join(back, (F.col("alias") == F.col("_from")) & (fold(F.col("term")) == F.col("_to")), "left_anti")


def fingerprint(chunks: DataFrame, version_ids: Sequence[str], seeds: Mapping[str, Sequence[str]]) -> str:
    """Digest of all that a glossary depends on: versions, chunks, seeds and the filter rules."""
    rows = chunks.select(F.struct("id", "content_sha256").alias("c")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list("c"))), 256).alias("d")).first()["d"]
    rules = [UNIT, IDENTIFIER, COMPARISON, CLAUSE_STARTS, CONTEXT_WORDS, GENERIC_LABELS, ZH_THEN_EN, EN_THEN_ZH]
    payload = {"versions": sorted(set(version_ids)), "chunks": rows, "seeds": {k: sorted(v) for k, v in seeds.items()}, "rules": rules}
    return payload_digest(payload)


def payload_digest(payload: object) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def load_or_mine(
    spark: SparkSession, path: str, chunks: DataFrame, version_ids: Sequence[str], seeds: DataFrame, reviewed: DataFrame
) -> dict[str, list[str]]:
    """The cached glossary at ``path`` if its fingerprint, count and digest hold, else a new one, which is then cached with its audit."""
    seed_map: dict[str, list[str]] = {}
    for r in seeds.unionByName(reviewed).collect():  # the reviewed lists are small and written by hand
        seed_map.setdefault(r["chinese"], []).append(r["english"])
    mark = fingerprint(chunks, version_ids, seed_map)
    try:
        rows = spark.read.json(path + "/cache", schema="schema int, fingerprint string, term_count int, digest string, terms map<string,array<string>>").collect()
        cached = rows[0] if len(rows) == 1 else None
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cached = None
    if cached and cached["schema"] == CACHE_VERSION and cached["fingerprint"] == mark and cached["terms"]:
        terms = {k: list(v) for k, v in cached["terms"].items()}
        if len(terms) == cached["term_count"] and payload_digest(terms) == cached["digest"] and _audited(spark, path, mark, terms, reviewed.unionByName(seeds)):
            return terms
    glossary, rejected = mine_glossary(chunks, seeds, reviewed)
    if faults := audit(glossary, reviewed.unionByName(seeds)).limit(5).collect():
        raise ValueError("invalid bilingual dictionary: " + "; ".join(f"{f['error']}: {f['term']!r} -> {f['alias']!r}" for f in faults))
    terms = {r["term"]: list(r["aliases"]) for r in glossary.collect()}  # bounded by the reviewed pairs
    row = [(CACHE_VERSION, mark, len(terms), payload_digest(terms), terms)]
    spark.createDataFrame(row, "schema int, fingerprint string, term_count int, digest string, terms map<string,array<string>>").coalesce(1).write.mode("overwrite").json(path + "/cache")
    rejected.write.mode("overwrite").json(path + "/rejected")
    told = {"fingerprint": mark, "accepted": _unique_pairs(terms), "rejected": spark.read.text(path + "/rejected").count()}
    spark.createDataFrame([(*told.values(), payload_digest(told))], AUDIT_FILE).coalesce(1).write.mode("overwrite").json(path + "/audit")
    return terms


AUDIT_FILE = "fingerprint string, accepted int, rejected int, digest string"


def seed_terms(seeds: DataFrame) -> dict[str, list[str]]:
    """Seeds as a glossary of both directions."""
    return {r["term"]: list(r["aliases"]) for r in group_aliases(seeds.select("english", "chinese")).collect()}  # written by hand, so small


def _unique_pairs(terms: Mapping[str, Sequence[str]]) -> int:
    """Unordered pairs of a glossary, case folded."""
    return len({frozenset((k.casefold(), a.casefold())) for k, v in terms.items() for a in v})


def _audited(spark: SparkSession, path: str, mark: str, terms: Mapping[str, Sequence[str]], trusted: DataFrame) -> bool:
    """Whether the audit beside a cached glossary is that of this glossary, its rejected candidates are all there, and the glossary still passes."""
    try:
        rows = spark.read.json(path + "/audit", schema=AUDIT_FILE).collect()
        rejected = spark.read.text(path + "/rejected").count()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False
    told = {"fingerprint": mark, "accepted": _unique_pairs(terms), "rejected": rejected}
    if [tuple(r) for r in rows] != [(*told.values(), payload_digest(told))]:
        return False
    return audit(spark.createDataFrame(list(terms.items()), "term string, aliases array<string>"), trusted).isEmpty()
