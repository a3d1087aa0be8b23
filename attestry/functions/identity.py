"""Host and URL identity, JSON field coercion, and lossless passage spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MAX_URL = 2048
NAME = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


@F.pandas_udf(StringType())
def _punycode(s: pd.Series) -> pd.Series:
    """Names beyond ASCII as the domain name system writes them, each distinct one once; null where that fails."""
    coded = {}
    for name in s.dropna().unique():
        try:
            coded[name] = name.encode("idna").decode()
        except UnicodeError:
            coded[name] = None
    return pd.Series([coded.get(x) for x in s], dtype=object)


def public_domain(c: Column) -> Column:
    """Public host name in ASCII lower case; null for anything else, IP literals and one-label names included.

    Two labels or more of letters, digits and inner hyphens, 63 characters at most each and 253 together; white space
    and dots at the end don't count. Only names beyond ASCII leave the JVM.
    """
    name = F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"\.+$", ""))
    plain = F.coalesce(_punycode(F.when(name.rlike(r"[^\x00-\x7F]") & ~name.rlike(r"[/:@?#\\ ]"), name)), name)
    good = plain.rlike(rf"^(?=.{{1,253}}$){NAME}(?:\.{NAME})+$") & ~plain.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    return F.when(good, plain)


def public_url(c: Column) -> Column:
    """Canonical http(s) URL, or null.

    No credentials, a public host, no default port, no fragment, path '/' if empty, at most 2048 characters.
    """
    pattern = r"(?is)^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
    text = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    scheme = F.lower(F.regexp_extract(text, pattern, 1))
    place = F.regexp_extract(text, pattern, 2)
    path = F.regexp_extract(text, pattern, 3)
    query = F.regexp_extract(text, pattern, 4)
    host = public_domain(F.regexp_extract(place, r"^([^:@]*)(?::\d*)?$", 1))
    port = F.regexp_extract(place, r":(\d+)$", 1)
    plain = (port == "") | ((scheme == "http") & (port.try_cast("int") == 80)) | ((scheme == "https") & (port.try_cast("int") == 443))
    url = F.concat(scheme, F.lit("://"), host, F.when(plain, "").otherwise(F.concat(F.lit(":"), port.try_cast("int").cast("string"))), F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query))
    good = (scheme != "") & ~place.contains("@") & host.isNotNull() & (plain | port.try_cast("int").between(0, 65535))
    return F.when(good & (F.char_length(url) <= MAX_URL), url)


def text_value(c: Column, limit: int = 1000) -> Column:
    """White space squeezed, cut to ``limit`` characters; blank gives null."""
    text = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(text != "", F.left(text, F.lit(limit)))


def aware_timestamp(c: Column) -> Column:
    """ISO time with an offset; without offset or malformed gives null."""
    text = F.trim(c)
    return F.when(text.rlike(r"(?i)^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"), text.try_cast("timestamp"))


def article_identity(c: Column) -> Column:
    """Struct (url, domain) of an https article, else null."""
    url = public_url(c)
    return F.when(url.startswith("https://"), F.struct(url.alias("url"), F.regexp_extract(url, r"^https://([^/:?]+)", 1).alias("domain")))


def discovery_problem(url: Column, domain: Column, title: Column, publisher: Column, language: Column, snippet: Column) -> Column:
    """The first reason to reject a discovery record, or null."""
    identity = article_identity(url)
    return (
        F.when(identity.isNull(), "URL")
        .when(~F.coalesce(public_domain(domain) == identity["domain"], F.lit(False)), "DOMAIN")
        .when(~F.coalesce((F.trim(title) != "") & (F.char_length(title) <= 1000), F.lit(False)), "TITLE")
        .when(~F.coalesce((F.trim(publisher) != "") & (F.char_length(publisher) <= 255), F.lit(False)), "PUBLISHER")
        .when(F.char_length(language) > 16, "LANGUAGE")
        .when(F.char_length(snippet) > 4000, "SNIPPET")
    )


def passage_ends(text: str, most: int) -> list[int]:
    """Ends of the passages of a text: after the last space or newline in the second half of ``most`` characters, else after all of them."""
    breaks = np.flatnonzero(np.isin(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32"), (10, 32))) + 1
    ends = [0]
    while len(text) - ends[-1] > most:
        full = ends[-1] + most
        last = int(breaks[k - 1]) if (k := int(np.searchsorted(breaks, full, "right"))) else 0
        ends.append(last if last > full - most + most // 2 else full)
    return [*ends[1:], len(text)]


def passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_chars: int = 800) -> DataFrame:
    """(``id_column``, ordinal, start_offset, end_offset, text, sha256): spans that put together give the text.

    Null and blank texts have no passage. Texts of any length are cut whole.
    """
    if not 100 <= max_chars <= 4000:
        raise ValueError("max_chars must lie between 100 and 4000")

    @F.pandas_udf(ArrayType(StructType([StructField("start_offset", IntegerType()), StructField("end_offset", IntegerType())])))
    def spans(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            ends = passage_ends(x, max_chars)
            out.append([{"start_offset": a, "end_offset": b} for a, b in zip([0, *ends], ends)])
        return pd.Series(out)

    kept = docs.where(F.col(text_column).rlike(r"(?U)\S")).select(F.col(id_column), F.col(text_column).alias("_text"))
    each = kept.select(id_column, "_text", F.posexplode(spans("_text")).alias("ordinal", "s"))
    part = F.substring(F.col("_text"), F.col("s.start_offset") + 1, F.col("s.end_offset") - F.col("s.start_offset"))
    return each.select(id_column, "ordinal", "s.start_offset", "s.end_offset", part.alias("text"), F.sha2(part, 256).alias("sha256"))
