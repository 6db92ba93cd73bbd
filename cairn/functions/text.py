"""Column helpers for strings: cleaning, searching, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\r\n"

# Entities that cleaned text may hold.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
# Accented letters and their bases.
ACCENTED, PLAIN = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.btrim(c, F.lit(BLANK)), F.lit(""))


def lower_trimmed(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(BLANK)))


def clean_html(c: Column) -> Column:
    """Text without tags, with common entities decoded and white space collapsed; null when nothing is left."""
    c = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return blank_to_null(F.regexp_replace(c, r"\s+", " "))


def language_list(c: Column) -> Column:
    """A list of languages from a line of HTML: a footnote after a line break goes, tags part entries, stars and blanks go."""
    c = F.regexp_replace(F.regexp_replace(c, "(?is)<br.*$", ""), "<[^>]+>", "")
    return F.filter(F.transform(F.split(F.replace(c, F.lit("*"), F.lit("")), ","), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")


def truncate_words(c: Column, n: int) -> Column:
    """At most n characters, cut after a word, with an ellipsis when anything was cut."""
    head = F.substring(c, 1, n - 1)
    cut = F.regexp_replace(head, r"\s+\S*$", "")
    return F.when(F.char_length(c) <= n, c).otherwise(F.concat(cut, F.lit("…")))


def fold(c: Column) -> Column:
    """Lower case without accents and with single spaces, for searching."""
    return F.btrim(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"\s+", " "))


def contains_word(text: Column, name: Column) -> Column:
    """Does text hold name as a whole word?"""
    spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[^0-9a-zA-Z]+", " "), F.lit(" "))
    return F.contains(spaced(text), spaced(name))


def year_of(c: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"((?:19|20)\d\d)", 1), F.lit("")), F.lit("9999")).cast("int")


def content_hash(*cols: Column, digits: int = 32) -> Column:
    """A prefix of SHA-256 over columns joined by a separator, null written as such."""
    parts = [F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits)


def keyed_hash63(c: Column, key: bytes) -> Column:
    """A 63-bit HMAC-SHA-256 of a string: its first 8 bytes as a number, shifted right by one."""
    key = key.ljust(64, b"\0")
    if len(key) > 64:
        raise ValueError("keys of more than 64 bytes must be hashed first")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(c, "UTF-8")), 256))
    h = F.sha2(F.concat(pad(0x5C), inner), 256)
    word = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("long")
    return F.shiftrightunsigned(F.shiftleft(word(1), 32).bitwiseOR(word(9)), 1)


def code_in(c: Column, names: list[str]) -> Column:
    """2 + place in a fixed list, whatever the case; 1 for anything else."""
    at = F.array_position(F.array(*map(F.lit, names)), F.lower(c))
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(1)).otherwise(at + 1).cast("int")


def fuzzy_all(name: Column, query: str) -> Column:
    """Do all terms of the query meet a word of the name: as its beginning, or within a fifth of their letters if longer than three?"""
    words = F.split(fold(name), r"[^0-9a-z]+")
    out = F.lit(True)
    for term in query.lower().split():
        near = F.exists(words, lambda w: (F.levenshtein(w, F.lit(term)) <= int(0.2 * len(term))) if len(term) > 3 else F.lit(False))  # noqa: B023
        out = out & (F.exists(words, lambda w: F.startswith(w, F.lit(term))) | near)  # noqa: B023
    return out
