"""Text and URL columns."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = r"^(utm_[^=]*|fbclid|gclid)(=|$)"


def normalize_url(url: Column) -> Column:
    """http(s) only, else null: scheme and host in lower case, default port, fragment and tracking parameters removed, other query text as it was."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^(?i)(https?)://", 1))
    host = F.lower(F.regexp_extract(u, r"^(?i)https?://([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_extract(u, r"^(?i)https?://[^/?]*([^?]*)", 1)
    kept = F.array_join(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: ~p.rlike(TRACKING)), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when((scheme != "") & (host != ""), whole)


def host_key(url: Column) -> Column:
    """host:port, the port by the scheme where the URL has none."""
    host = F.lower(F.regexp_extract(url, r"^(?i)https?://([^/?#:]*)", 1))
    port = F.regexp_extract(url, r"^(?i)https?://[^/?#:]*:([0-9]+)", 1)
    default = F.when(url.rlike(r"^(?i)https://"), "443").otherwise("80")
    return F.when(host != "", F.concat(host, F.lit(":"), F.when(port == "", default).otherwise(port)))


_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))


def comparable(text: Column) -> Column:
    """Full-width ASCII to ASCII, letters and numbers only, lower case."""
    return F.lower(F.regexp_replace(F.translate(text, _WIDE, _NARROW), r"[^\p{IsAlphabetic}\p{N}]", ""))


def bigrams(text: Column) -> Column:
    """Pairs of adjacent characters, by one look-ahead match each."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(?=(..))"), F.lit(1))


def one_line(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def terms(text: Column) -> Column:
    """The words of a search text; the ideographic space separates too."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def mentions(text: Column, word: Column) -> Column:
    """Whether a word stands in a text: not within a longer word of ASCII letters and digits, a plural s or es may follow; upper-case abbreviations
    keep their case."""
    escaped = F.regexp_replace(word, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    case = F.when(word.rlike("^[A-Z0-9]*[A-Z][A-Z0-9]*$"), "").otherwise("(?i)")
    return F.regexp_like(one_line(text), F.concat(case, F.lit("(^|[^A-Za-z0-9])"), escaped, F.lit("(es|s)?($|[^A-Za-z0-9])")))


def contains_literal(text: Column, term: Column | str) -> Column:
    """Term as it stands, no wildcards, case folded."""
    return F.contains(F.lower(text), F.lower(F.lit(term) if isinstance(term, str) else term))


def date_in(text: Column) -> Column:
    """The first year, month and day of a text."""
    parts = [F.regexp_extract(text, r"(\d{4})\D+(\d{1,2})\D+(\d{1,2})", k) for k in (1, 2, 3)]
    return F.try_to_date(F.when(parts[0] != "", F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))), "yyyy-MM-dd")


def date_in_name(url: Column) -> Column:
    """yyyymmdd or yymmdd in a URL's file name."""
    name = F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1)
    long, short = F.regexp_extract(name, r"(20\d{6})", 1), F.regexp_extract(name, r"(?<!\d)(\d{6})(?!\d)", 1)
    return F.coalesce(F.try_to_date(F.when(long != "", long), "yyyyMMdd"), F.try_to_date(F.when(short != "", F.concat(F.lit("20"), short)), "yyyyMMdd"))


def glob_to_regex(pattern: Column) -> Column:
    """A crawl rule's path with * anywhere and $ at the end, as a pattern anchored at the start."""
    plain = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\.\[\]{}()+?^|$])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(plain, r"\*", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))


