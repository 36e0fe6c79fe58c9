"""Text functions as Column expressions; Arrow UDFs only where no built-in has the semantics."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce
from string import ascii_lowercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

# They decide results, and must stay as they are.
CJK_RUN = "[㐀-鿿]+"
ASCII_TOKEN = "[A-Za-z0-9]+(?:[./+_-][A-Za-z0-9]+)*"
#: Names, spaced spellings and right spellings of the spacing rules, in the order of use.
SPACING_RULES = [
    ("maximum_intensity", "m a x i m u m i n t e n s i t y", "maximum intensity"),
    ("apparent_diffusion", "a p p a r e n t d i f f u s i o n", "apparent diffusion"),
    ("split_tumor", "t u m o r", "tumor"),
    ("split_local", "l o c a l", "local"),
    ("split_anti", "a n t i -", "anti-"),
    ("split_cancer", "c a n c e r", "cancer"),
    ("split_tcb", "T C b", "TCb"),
    ("split_her2", "H E R 2", "HER2"),
    ("split_cdk4_6", "C D K 4 / 6", "CDK4/6"),
    ("split_bmi", "B M I", "BMI"),
    ("split_36_ku", "3 6 k U", "36 kU"),
    ("split_ku", "k U", "kU"),
    ("split_prepare_registration", "P R E P A R E - ", "PREPARE-"),
    ("split_prepare", "P R E P A R E", "PREPARE"),
    ("split_nci_ctcae", "N C I -C T C A E 5 . 0", "NCI-CTCAE 5.0"),
    ("split_mg_kg", "m g / k g", "mg/kg"),
    ("split_bibliographic_surnames", "B L O K E J , K R O E P J R , M E E R S H O E K - K L E I N KRANENBARG E", "BLOK E J, KROEP J R, MEERSHOEK-KLEIN KRANENBARG E"),
]
SPACE_CLASS = "[ \t  ]+"
SUSPICIOUS_SPACING = f"(?<![A-Za-z])(?:[a-z]{SPACE_CLASS})+[a-z](?![A-Za-z])"
MAX_CHUNK_CHARS = 900

#: White space as Python's str.split() sees it.
UNICODE_SPACE = r"(?U)[\s\x1c-\x1f\x85]+"


#: Most rows and bytes of an Arrow batch of texts, and rows that are Python objects at one time.
BATCH_ROWS, BATCH_BYTES, PYTHON_ROWS = 2000, 4 << 20, 100


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that a Python worker does not grow with the texts; smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def in_parts(values: pa.Array, f: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """``f`` of each text, of a few rows at a time; null stays null."""
    parts = (values.slice(at, PYTHON_ROWS).to_pylist() for at in range(0, len(values), PYTHON_ROWS))
    done = [pa.array([None if v is None else f(v) for v in part], kind) for part in parts]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def _by_python(text: Column, f: Callable[[str], object], needed: Column, returned: DataType, kind: pa.DataType) -> Column:
    """``f`` of the texts for which it is ``needed``, null for the others, which Python does not get."""

    def run(values: pa.Array) -> pa.Array:
        return in_parts(values, f, kind)

    if spark := SparkSession.getActiveSession():
        small_batches(spark)
    return F.arrow_udf(run, returned)(F.when(needed, text))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it inside array functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ngrams(run: Column, n: int) -> Column:
    """All overlapping substrings of n code points."""

    def cut(signs: Column) -> Column:
        count = F.size(signs) - (n - 1)
        some = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(*(F.get(signs, i + k) for k in range(n))))
        return F.when(count >= 1, some).otherwise(F.array().cast("array<string>"))

    # The text as an array of signs first: substring() would walk from the start for each place.
    return let(F.filter(F.split(run, ""), lambda c: c != ""), cut)


#: A word with the blank behind it, of at most 31 code points, and the two code points that follow (group 1).
_WITH_NEXT = r"(?s)(?=(([^ ]{0,30} |[^ ]{1,31})..))\2"


def ngram_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): how often each run of two and of three code points stands in the texts.

    Texts are cut to words, each with the two code points after it, so that every run of three lies in one of them; equal words are
    counted first, their inside and the four code points around their end again, and these are cut to runs once. The runs of two are the heads of the runs of three and the end of each text.
    """
    whole = F.regexp_extract_all(text, F.lit(_WITH_NEXT), 1)
    ends = F.when(F.char_length(text) >= 2, F.array(F.right(F.col(text), F.lit(2)))).otherwise(F.array().cast("array<string>"))
    parts = df.select(F.explode_outer(F.concat(whole, ends)).alias("part")).where("part is not null").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    size, part = F.char_length("part"), F.col("part")
    inside = F.when(size >= 5, F.array(F.left(part, size - 2), F.right(part, F.lit(4)))).otherwise(F.array(F.right(part, F.lit(4))))
    parts = parts.select("n", F.explode_outer(inside).alias("part")).groupBy("part").agg(F.sum("n").alias("n"))
    heads = ngrams(F.col("part"), 2)
    runs = F.when(F.char_length("part") == 2, F.array("part")).otherwise(F.concat(F.slice(heads, F.lit(1), F.greatest(F.size(heads) - 1, F.lit(0))), ngrams(F.col("part"), 3)))
    return parts.select("n", F.explode_outer(runs).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))


def tokens(text: Column) -> Column:
    """Tokens of bilingual text as a bag: bigrams and trigrams of CJK runs (a single sign stays), ASCII terms lower-cased.

    Equals the positional order of runs only as a multiset, which is all that BM25 reads.
    """
    words = F.transform(F.regexp_extract_all(text, F.lit(f"({ASCII_TOKEN})"), 1), F.lower)
    runs = F.regexp_extract_all(text, F.lit(f"({CJK_RUN})"), 1)
    grams = F.flatten(
        F.transform(runs, lambda r: F.when(F.char_length(r) == 1, F.array(r)).otherwise(F.concat(ngrams(r, 2), ngrams(r, 3))))
    )
    return F.when(text.rlike(CJK_RUN), F.concat(grams, words)).otherwise(words)


def _nfkc_value(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def _nfkc(text: Column) -> Column:
    """NFKC; ASCII is its own."""
    return F.coalesce(_by_python(text, _nfkc_value, text.rlike(r"[^\x00-\x7F]"), StringType(), pa.string()), text)


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Lower-case signs that case folding changes, with theirs, and those that fold to several (by rule, from the interpreter's tables)."""
    odd = {c: c.casefold() for c in map(chr, range(0x80, 0x110000)) if c.casefold() != c == c.lower()}
    one = {c: f for c, f in odd.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in odd.items() if len(f) > 1}


def fold(text: Column) -> Column:
    """Unicode case folding, which lower() alone is not (ß, final sigma), for terms: sign by sign where a term is not ASCII."""
    one, to, many = _folds()
    low = F.lower(text)
    spelled = F.create_map(*(F.lit(x) for pair in many.items() for x in pair))
    signs = F.transform(F.split(F.translate(low, one, to), ""), lambda c: F.coalesce(F.try_element_at(spelled, c), c))
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.array_join(signs, "")).otherwise(low)


def _folded_for(text: Column, term: str, more: str = "") -> Column:
    """A text, folded as far as it matters for finding a folded term: signs that fold to one of its signs, or to one of ``more``."""
    one, to, many = _folds()
    wanted = set(term) | set(more)
    odd = {c: f for c, f in (dict(zip(one, to, strict=True)) | many).items() if wanted & set(f)}
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(odd[c])), odd, F.lower(text))


def normalize_text(text: Column) -> Column:
    """NFKC, all white space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(_nfkc(text), UNICODE_SPACE, " "))


def collapse_ascii(text: Column) -> Column:
    """White space to single spaces and trimmed, without NFKC: stays in codegen."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def text_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def diff_id(prior: Column, current: Column, chunk: Column) -> Column:
    """Digest of two version ids and a chunk id, NUL between them."""
    return F.sha2(F.concat_ws("\u0000", prior, current, chunk), 256)


def quote(literal: str) -> str:
    """A literal as a Java regular expression."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def contains_variant(text: Column, variant: str) -> Column:
    """Whether a text has a term: anywhere for CJK terms, as a whole word otherwise; case is folded."""
    term = variant.casefold().strip()
    if not term:
        return F.lit(False)
    if any("㐀" <= c <= "鿿" for c in term):
        return _folded_for(text, term).contains(term)
    return _folded_for(text, term, ascii_lowercase).rlike(f"(?<![A-Za-z0-9]){quote(term)}(?![A-Za-z0-9])")


def matches_concepts(text: Column, groups: list[list[str]]) -> Column:
    """One group or none passes all; otherwise every group has a variant in the text."""
    if len(groups) <= 1:
        return F.lit(True)
    return reduce(
        lambda a, b: a & b, [reduce(lambda a, b: a | b, [contains_variant(text, v) for v in g], F.lit(False)) for g in groups]
    )


def _spaced(source: str) -> str:
    return SPACE_CLASS.join(quote(part) if part else "" for part in source.split(" "))


def normalize_spacing(text: Column) -> tuple[Column, dict[str, Column]]:
    """The text after all spacing rules, and how often each rule applied."""
    counts = {}
    for name, source, target in SPACING_RULES:
        pattern = _spaced(source)
        counts[name] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, target.replace("\\", "\\\\").replace("$", "\\$"))
    return text, counts


def suspicious_spacing(text: Column) -> Column:
    """Runs of single lower-case letters with spaces between them."""
    return F.regexp_extract_all(text, F.lit(f"({SUSPICIOUS_SPACING})"), 1)


_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+(?:>|\Z)"""
#: Comments, declarations, tags, and scripts and styles with what they hold. What is not closed runs to the end, so no part is looked at twice.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<raw>script|style)\b{_ATTRIBUTES}(?P<body>.*?)(?=</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-z][^\s/>]*){_ATTRIBUTES}",
    re.I | re.S,
)


def html_to_text_value(markup: str) -> str:
    """Character data of a fragment: markup goes, a br leaves a newline, and then references are decoded, but not in scripts and styles."""

    def left(m: re.Match) -> str:
        if m["raw"]:
            return m["body"].replace("&", "&amp;")
        return "\n" if (m["name"] or "").lower() == "br" and not m["end"] else ""

    return html.unescape(_MARKUP.sub(left, markup))


def html_to_text(text: Column) -> Column:
    """All character data of a fragment, references decoded, a newline for each br."""
    return F.coalesce(_by_python(text, html_to_text_value, text.rlike("[<&]"), StringType(), pa.string()), text)


IMAGE_BLOCK = r"(?is)<div\b[^>]*>\s*<img\b[^>]*>\s*</div>"


def normalize_block(text: Column) -> Column:
    """A text block without images, markup, rules and trailing blanks."""
    plain = F.regexp_replace(html_to_text(F.regexp_replace(text, IMAGE_BLOCK, "")), "\r\n|\r", "\n")
    lines = F.filter(F.split(plain, "\n", -1), lambda v: ~v.rlike(r"^\s*---+\s*$"))
    return F.regexp_replace(F.array_join(F.transform(lines, lambda v: F.regexp_replace(v, r"(?U)\s+$", "")), "\n"), r"(?U)^\s+|\s+$", "")


def split_long_value(text: str, most: int = MAX_CHUNK_CHARS) -> list[str]:
    """Pieces of at most ``most`` code points that end after a sentence end where the piece has one; nothing is lost."""
    out, at = [], 0
    while len(text) - at > most:
        end = max(text.rfind(mark, at, at + most) for mark in "。！？；\n")
        cut = end + 1 if end >= at else at + most
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) else out


def split_long(text: Column) -> Column:
    """The pieces of ``split_long_value``; a short text is its own piece."""
    long = F.char_length(text) > MAX_CHUNK_CHARS
    cut = _by_python(text, split_long_value, long, ArrayType(StringType()), pa.list_(pa.string()))
    return F.when(long, cut).when(text == "", F.array().cast("array<string>")).when(text.isNotNull(), F.array(text))


def match_tokens(text: Column) -> Column:
    """Tokens for matching contexts: bigrams of the text without white space, and its parts between commas, lower-cased."""
    return let(
        F.regexp_replace(F.lower(text), r"(?U)\s+", ""), lambda bare: F.array_union(ngrams(bare, 2), F.filter(F.split(bare, "[，、]"), lambda v: v != ""))
    )


def containment(a: Column, b: Column) -> Column:
    """Share of b's distinct tokens that a has; 0 where b has none."""
    return F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(b))).otherwise(F.lit(0.0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def inline_text(text: Column, joined: bool = True) -> Column:
    """A cell's text in one line (``joined``), or with its newlines made uniform and its ends trimmed. Without white space it stays."""
    if joined:
        lines = F.transform(F.split(text, "\r\n|\n|\r"), lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", ""))
        line = F.array_join(F.filter(lines, lambda v: v != ""), " ")
    else:
        line = F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), r"(?U)^\s+|\s+$", "")
    return F.when(text.rlike(r"(?U)\s"), line).otherwise(text)


def text_digest(order: Column, text: Column) -> Column:
    """Aggregate: digest of all texts in order, each ended by NUL."""
    sorted_texts = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda v: F.concat(v["t"], F.lit("\u0000")))
    return F.sha2(F.array_join(sorted_texts, ""), 256)
