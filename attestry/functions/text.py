"""Column functions on text. Null in gives null out unless stated otherwise."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

# Bracket marks of the page dump.
BRACKET_MARKS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sql_trim(c: Column) -> Column:
    """Spaces at the ends removed, as SQL TRIM does."""
    return F.trim(c)


def py_strip(c: Column) -> Column:
    """White space of any kind at the ends removed."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def non_blank(c: Column) -> Column:
    """Not null and not only spaces."""
    return c.isNotNull() & (F.trim(c) != "")


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case words: letters, digits and underscores (F1). Compatible characters are as written; see ``nfkc_tokens``."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def each_value(s: pd.Series, f) -> pd.Series:
    """``f`` of every value, null for null; object values also where all are null."""
    return pd.Series([None if x is None else f(x) for x in s], dtype=object)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return each_value(s, lambda x: unicodedata.normalize("NFKC", x))


def nfkc_tokens(c: Column) -> Column:
    """``tokens`` after NFKC, for indexes and queries that must not tell compatible characters apart."""
    return tokens(nfkc(c))


@F.pandas_udf(ArrayType(StringType()))
def folded_tokens(s: pd.Series) -> pd.Series:
    """Words after NFKC and case folding (F2)."""
    return each_value(s, lambda x: re.findall(r"\w+", unicodedata.normalize("NFKC", x).casefold()))


def nfkc(c: Column) -> Column:
    """NFKC. ASCII texts, which it leaves alone, stay in the JVM."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def shingles(words: Column, width: int = 5) -> Column:
    """Distinct runs of ``width`` words, joined by spaces (F3). Fewer words: an empty array.

    Made of shifted slices side by side: a lambda that took slices itself would work out ``words`` anew for each run.
    """
    n = F.greatest(F.size(words) - width + 1, F.lit(0))
    runs = reduce(
        lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(" "), y)), [F.slice(words, k + 1, n) for k in range(width)]
    )
    return F.array_distinct(runs)


def unmark(c: Column, ignore_case: bool = False) -> Column:
    """Bracket marks to brackets."""
    for mark, sign in BRACKET_MARKS.items():
        c = F.regexp_replace(c, f"(?i){mark}", sign) if ignore_case else F.replace(c, F.lit(mark), F.lit(sign))
    return c


def canonical_text(c: Column) -> Column:
    """Case, punctuation and spacing dropped: lower-case words joined by a space."""
    return F.array_join(tokens(unmark(c, ignore_case=True)), " ")


def is_disambiguation_page(c: Column) -> Column:
    """Page id that ends in a bracketed 'disambiguation' (F5)."""
    return F.replace(F.lower(unmark(c, ignore_case=True)), F.lit("_"), F.lit(" ")).rlike(r"\(\s*disambiguation\s*\)$")


def title_words(c: Column) -> Column:
    """Words of a title or claim: marks decoded, underscores as spaces, lower case."""
    return F.array_join(tokens(F.replace(unmark(c, ignore_case=True), F.lit("_"), F.lit(" "))), " ")


def page_title(c: Column) -> Column:
    """Struct (base, qualifier) of a page id; the qualifier is the last bracket at the end, or null."""
    text = F.replace(unmark(c, ignore_case=True), F.lit("_"), F.lit(" "))
    pattern = r"^(.*?)\s*\(([^()]*)\)\s*$"
    has = text.rlike(pattern)
    base = F.when(has, F.regexp_extract(text, pattern, 1)).otherwise(text)
    return F.struct(title_words(base).alias("base"), F.when(has, title_words(F.regexp_extract(text, pattern, 2))).alias("qualifier"))


def wiki_title(c: Column) -> Column:
    """Title with underscores and hyphens as spaces, NFKC (F8)."""
    return squeeze(F.regexp_replace(nfkc(c), r"[_\-]+", " "))


def query_text(c: Column) -> Column:
    """Query with white space squeezed, NFKC (F8)."""
    return squeeze(nfkc(c))


def clean_text(c: Column) -> Column:
    """Display form: marks decoded, white space squeezed, none before ``, . ; : ! ?``."""
    return F.trim(F.regexp_replace(F.regexp_replace(unmark(c), r"(?U)\s+", " "), r"\s+([,.;:!?])", "$1"))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether a phrase of normalised words occurs in normalised text at word borders; an empty phrase doesn't."""
    return let(phrase, lambda p: (p != "") & F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" "))))


# Patterns that make a claim locative, and words that speak of copies or versions.
LOCATIVE = (
    r"\b(?:is|are|was|were)\s+(?:not\s+)?(?:located|situated|based)\s+in\b"
    r"|\b(?:is|are|was|were)\s+(?:not\s+)?in\b|\b(?:stands|stood)\s+in\b"
)
COMPARISON = r"\b(?:replicas?|copy|copies|models?|imitations?|different|multiple|versions?|inspired)\b"


def locative_claim(words: Column) -> Column:
    """A claim about a place that doesn't speak of copies or versions."""
    return words.rlike(LOCATIVE) & ~words.rlike(COMPARISON)


def token_multiset(c: Column) -> Column:
    """Sorted words with repetitions (F29): equal for equal multisets."""
    return F.array_sort(F.split(c, " "))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


# Predicates that end a subject, words that make it generic, articles, and words of film context.
PREDICATES = "is|are|was|were|has|have|had|contains?|included|includes|became|becomes|produced|directed|written|released|located|situated"
GENERIC = ("a", "an", "most", "some", "many", "all", "every", "this", "that", "these", "those")
SEARCH_PREDICATES = "is|are|was|were|has|have|had|contains?|includes?|became|will|can|did|does|do"
ARTICLES = ("the", "a", "an")
FILM = "directed|filmed|shot|starring|produced|movie|film"


def _upper_first(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def subject_anchor(claim: Column) -> Column:
    """Named subject at the start of a claim, as normalised words; null where it isn't sure.

    The subject ends before the first predicate; a possessive keeps the owner only, otherwise a place
    after in, at or near is cut off. A generic first word, a lower-case first word after 'the', or a
    lower-case last word gives null.
    """
    text = F.regexp_replace(py_strip(claim), '^["“”]+|["“”]+$', "")
    strip = r"^[ ,.;:!?\t]+|[ ,.;:!?\t]+$"
    owner = r"^([A-Z][\p{L}\p{N}_-]*(?:\s+[A-Z][\p{L}\p{N}_-]*)*)['’]s\b"

    def named(words: Column) -> Column:
        return F.when(F.lower(F.get(words, F.lit(0))) == "the", F.slice(words, 2, F.greatest(F.size(words), F.lit(0)))).otherwise(words)

    def anchor(words: Column) -> Column:
        name = named(words)
        good = (F.size(name) > 0) & _upper_first(F.get(name, F.lit(0))) & ((F.size(name) == 1) | _upper_first(F.get(name, F.size(name) - 1)))
        phrase = let(title_words(F.array_join(name, " ")), lambda p: F.when(p != "", p))
        return F.when((F.size(words) > 0) & ~F.lower(F.get(words, F.lit(0))).isin(*GENERIC) & good, phrase)

    def of_subject(subject: Column) -> Column:
        kept = let(F.regexp_extract(subject, owner, 1), lambda o: F.when(o != "", o).otherwise(py_strip(F.element_at(F.split(subject, r"(?i)\s+(?:in|at|near)\s+"), 1))))
        return let(F.regexp_extract_all(kept, F.lit(r"(?U)\b[A-Za-z][\w'-]*\b"), F.lit(0)), anchor)

    subject = let(text, lambda t: F.when(t.rlike(rf"(?i)\s+(?:{PREDICATES})\b"), F.regexp_replace(F.regexp_extract(t, rf"(?is)^(.*?)\s+(?:{PREDICATES})\b", 1), strip, "")))
    return let(subject, of_subject)


def subject_queries(claim: Column) -> Column:
    """At most two further searches for the subject of a claim (F11); an empty array where it isn't sure."""
    subject = F.regexp_replace(F.regexp_extract(claim, rf"(?is)^(.*?)\s+(?:{SEARCH_PREDICATES})\b", 1), '^[ "“”.,;:!?]+|[ "“”.,;:!?]+$', "")
    generic = tuple(g for g in GENERIC if g not in ARTICLES)
    nothing = F.array().cast("array<string>")

    def found(words: Column) -> Column:
        first = F.lower(F.get(words, F.lit(0)))
        name = F.when(first.isin(*ARTICLES), F.slice(words, 2, F.greatest(F.size(words), F.lit(0)))).otherwise(words)
        last = F.get(name, F.size(name) - 1)
        good = (
            F.size(words).between(1, 7) & ~first.isin(*generic) & (F.size(name) > 0) & _upper_first(F.get(name, F.lit(0)))
            & ((F.size(name) == 1) | _upper_first(last) | ((F.size(name) == 2) & (F.lower(last) == "sequel")))
        )
        return F.when(F.coalesce(good, F.lit(False)), let(F.array_join(words, " "), searches)).otherwise(nothing)

    def searches(text: Column) -> Column:
        owner = F.regexp_extract(text, r"(?i)^(.+?)['’]s sequel$", 1)
        film = claim.rlike(rf"(?i)\b(?:{FILM})\b") & ~F.lower(text).endswith(" film")
        of_film = F.when(film, F.array(text, F.concat(text, F.lit(" film")))).otherwise(F.array(text))
        return let(owner, lambda o: F.when(o != "", F.array(F.concat(o, F.lit(" 2")), F.concat(o, F.lit(" sequel film")))).otherwise(of_film))

    has = F.coalesce(claim.rlike(rf"(?i)\s+(?:{SEARCH_PREDICATES})\b"), F.lit(False))
    return F.when(has, let(F.regexp_extract_all(subject, F.lit(r"[A-Za-z][A-Za-z0-9'’-]*"), F.lit(0)), found)).otherwise(nothing)


def sha256_hex(c: Column) -> Column:
    """Hex SHA-256 of the UTF-8 bytes (F16)."""
    return F.sha2(c, 256)


def is_sha256(c: Column) -> Column:
    """Sixty-four lower-case hex digits."""
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def actor_fingerprint(key: bytes, prefix: int = 24):
    """A function of a column: hex HMAC-SHA256 cut to ``prefix`` digits."""

    @F.pandas_udf(StringType())
    def fingerprint(s: pd.Series) -> pd.Series:
        return each_value(s, lambda x: hmac.new(key, x.encode(), hashlib.sha256).hexdigest()[:prefix])

    return fingerprint

