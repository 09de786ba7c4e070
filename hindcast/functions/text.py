"""Text expressions: terms, fingerprints, capping and excerpts. All JVM-side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

TERM_BREAK = r"[^\p{L}\p{N}]"
BLANKS = r"[ \t\n\r\f]+"


def search_terms(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in text order."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), TERM_BREAK + "+"), lambda t: t != "")


def query_terms(query: str | None) -> list[str]:
    """The same rule for a query string on the driver; each term once."""
    if not query:
        return []
    kept = "".join(ch if unicodedata.category(ch)[0] in "LN" else " " for ch in query.lower())
    return list(dict.fromkeys(kept.split()))


def normalised(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BLANKS, " "))


def fingerprint(text: Column | str) -> Column:
    """md5 of the lower-cased text with blanks collapsed; null counts as empty."""
    return F.md5(normalised(text).cast("binary"))


def whole_word(term: str) -> str:
    """Regex of a term with no letter or digit on either side. A term consists
    of letters and digits only, so nothing in it needs escaping."""
    return rf"(?<![\p{{L}}\p{{N}}]){term}(?![\p{{L}}\p{{N}}])"


def term_count(text: Column | str) -> Column:
    """How many terms a text has, without building them."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}]+"))


def term_uses(text: Column | str, term: str) -> Column:
    """How often a term occurs. The regex runs only where a plain search hits."""
    text = F.col(text) if isinstance(text, str) else text
    return (F.when(F.contains(F.lower(text), F.lit(term)),
                   F.regexp_count(F.lower(text), F.lit(whole_word(term)))).otherwise(0))


def term_position(text: Column | str, term: str) -> Column:
    """1-based position of the first whole-word occurrence, 0 if none, counted
    in characters (regex positions would count UTF-16 units)."""
    text = F.col(text) if isinstance(text, str) else text
    upto = F.length(F.regexp_extract(F.lower(text), f"(?s)^(.*?{whole_word(term)})", 1))
    return (F.when(F.contains(F.lower(text), F.lit(term)) & (upto > 0), upto - len(term) + 1)
            .otherwise(0))


def first_hit(text: Column | str, terms: list[str]) -> Column:
    """Position of the earliest whole-word hit of any term, 0 if none."""
    hits = F.filter(F.array(*[term_position(text, t) for t in terms]), lambda p: p > 0)
    return F.coalesce(F.array_min(hits), F.lit(0))


def same_words(left: Column, right: Column) -> Column:
    """True where both are present and equal apart from case and outer blanks."""
    return F.coalesce(F.lower(F.trim(left)) == F.lower(F.trim(right)), F.lit(False))
