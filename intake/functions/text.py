"""Text normalisation, signals, and redaction as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strip(c: str) -> str:
    bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
    return unicodedata.normalize("NFC", bare)


@cache
def _accents() -> tuple[str, str]:
    """Characters with marks and the same without, for `translate`; all that decompose to one other character."""
    pairs = [(chr(i), _strip(chr(i))) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Mn", "Cn")]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def _grown() -> tuple[str, str]:
    """Characters that become several in upper case, and stand-ins of the private use area: simple case mapping leaves them alone."""
    grown = "".join(chr(i) for i in range(0x80, min(0x10000, sys.maxunicode)) if not 0xD800 <= i < 0xE000 and len(chr(i).upper()) > 1) + "ı"
    return grown, "".join(chr(0xE000 + i) for i in range(len(grown)))


def normalize_text(c: Column) -> Column:
    """Upper case, no marks, single spaces, trimmed; NULL is empty. One-to-one case mapping, as of an invariant culture."""
    grown, stand_in = _grown()
    text = F.coalesce(c, F.lit(""))
    raised = F.translate(F.upper(F.translate(text, grown, stand_in)), stand_in, grown)
    bare = F.regexp_replace(F.translate(raised, *_accents()), r"\p{Mn}", "")
    # plain ASCII has no marks and its upper case is its own, so it is spared the three passes over the tables
    return F.trim(F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(bare, r"[\p{Z}\t-\r\x{85}]+", " ")).otherwise(F.regexp_replace(F.upper(text), r"[ \t-\r]+", " ")))


def compact_text(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(c, r"[^\p{L}\p{Nd}]", "")


def padded(norm: Column) -> Column:
    """A normalized text between spaces, for callers that look for many phrases in it."""
    return F.concat(F.lit(" "), norm, F.lit(" "))


def contains_phrase(norm: Column, phrase: str, is_padded: bool = False) -> Column:
    """The phrase as whole words between spaces. is_padded: `norm` is `padded` already."""
    return F.contains(norm if is_padded else padded(norm), F.lit(f" {phrase} "))


def _compact(phrase: str) -> str:
    return "".join(x for x in phrase if x.isalnum())


def contains_signal(norm: Column, compact: Column, phrase: str, is_padded: bool = False) -> Column:
    """As whole words; several words also run together, through any punctuation."""
    found = contains_phrase(norm, phrase, is_padded)
    return found | F.contains(compact, F.lit(_compact(phrase))) if " " in phrase else found


def signal_group_count(norm: Column, compact: Column, groups: tuple[tuple[str, ...], ...], is_padded: bool = False) -> Column:
    """How many groups of synonyms have a hit."""
    total = F.lit(0)
    for group in groups:
        hit = F.lit(False)
        for phrase in group:
            hit = hit | contains_signal(norm, compact, phrase, is_padded)
        total = total + hit.cast("int")
    return total


def first_signal(norm: Column, compact: Column, signals: tuple[str, ...], is_padded: bool = False) -> Column:
    """The first signal of the list that is there, NULL if none is."""
    return F.coalesce(*(F.when(contains_signal(norm, compact, s, is_padded), s) for s in signals))


def _holds(text: Column, n: int, other: str, one: str) -> Column:
    """At least `n` matches of `one`, of which `other` passes what lies between. A search that ends at the n-th match and goes back nowhere: a
    count of all of them would make a list of every letter."""
    return text.rlike(rf"\A(?:(?:{other})*+{one}){{{n}}}")


def useful_page_text(c: Column) -> Column:
    """30 letters or digits."""
    return _holds(F.coalesce(c, F.lit("")), 30, r"[^\p{L}\p{N}]", r"[\p{L}\p{N}]")


def useful_ocr_text(c: Column) -> Column:
    """30 letters or digits, 15 letters, 5 words of two characters."""
    text = F.coalesce(c, F.lit(""))
    words = _holds(text, 5, r"\P{L}|\p{L}(?![\p{L}\p{N}])", r"\p{L}[\p{L}\p{N}]++")
    return _holds(text, 30, r"[^\p{L}\p{Nd}]", r"[\p{L}\p{Nd}]") & _holds(text, 15, r"\P{L}", r"\p{L}") & words


#: Fixed values.
REDACT_URL = r"(?i)https?://\S+"
URL_LEFT_OUT = "[URL omitida]"
REDACT_SECRET = r"(?i)(client[_ ]?secret|access[_ ]?token|refresh[_ ]?token|authorization[_ ]?code|code|token)\s*[:=]\s*[^\s,;]+"


def redact(c: Column, longest: int = 500) -> Column:
    """One line, without URLs and secrets, cut with an ellipsis."""
    line = F.trim(F.translate(F.coalesce(c, F.lit("")), "\r\n", "  "))
    safe = F.regexp_replace(F.regexp_replace(line, REDACT_URL, URL_LEFT_OUT), REDACT_SECRET, "$1=[REDACTADO]")
    return F.when(F.length(safe) > longest, F.concat(F.substring(safe, 1, longest), F.lit("..."))).otherwise(safe)


def base64url_strict(c: Column) -> Column:
    """Bytes of a base64url text; NULL for a blank one, a length that no encoding has, and foreign characters."""
    body = F.translate(c, "-_", "+/")
    rest = F.length(body) % 4
    padded = F.concat(body, F.repeat(F.lit("="), (4 - rest) % 4))
    return F.when((F.trim(body) != "") & (rest != 1), F.try_to_binary(padded, F.lit("base64")))
