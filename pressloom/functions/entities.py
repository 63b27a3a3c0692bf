"""Character references of HTML as column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from .binding import let

# A reference with its end: a number, or a name that may lack its semicolon.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
# Names that count without a semicolon, the longest first.
_OPEN = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# What numbers 128 to 159 stand for, by the Windows-1252 table of the HTML standard.
_WINDOWS = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
_LOST = "�"


def _map(pairs: dict, kind: str = "map<string,string>") -> Column:
    """A constant map, folded from one literal while the query is planned."""
    return F.from_json(F.lit(json.dumps(pairs)), kind)


def character(code: Column) -> Column:
    """The character of a code point; U+FFFD for zero, surrogates and numbers beyond Unicode. Noncharacters stay."""
    def of(c: Column) -> Column:
        valid = (c > 0) & (c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
        four = F.unhex(F.lpad(F.hex(c), 8, "0"))
        return F.when(c.between(128, 159), F.try_element_at(_map(_WINDOWS), c.cast("string"))).when(
            valid, F.decode(four, "UTF-32")).otherwise(F.lit(_LOST))
    return let(code, of)


def _code(body: Column) -> Column:
    """The number that a body ``#...`` writes; one beyond Unicode for numbers of more digits than any code point has."""
    def read(digits: Column) -> Column:
        number = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10).try_cast("long")).otherwise(digits.try_cast("long"))
        return F.when(F.length(digits) > 7, F.lit(0x110000)).otherwise(number)
    return let(F.regexp_replace(body, "^#[xX]?0*", ""), read)


def _named(ref: Column, body: Column) -> Column:
    """What a name stands for, with its semicolon or by the longest name it begins with; null if it is none."""
    # a constant map is searched from its start, so names lie in one map per first letter
    initials = sorted({n[0] for n in html5})
    names = _map({i: {n[:-1]: c for n, c in html5.items() if n[0] == i and n.endswith(";")} for i in initials}, "map<string,map<string,string>>")
    opened = _map({n: html5[n] for n in _OPEN})
    whole = F.when(F.endswith(ref, F.lit(";")), F.try_element_at(F.try_element_at(names, F.substring(body, 1, 1)), body))
    prefix = let(F.regexp_extract(body, "^(" + "|".join(_OPEN) + ")", 1), lambda head: F.when(
        head != "", F.concat(F.try_element_at(opened, head), F.substr(ref, F.length(head) + 2))))
    return F.coalesce(whole, prefix)


def reference(ref: Column) -> Column:
    """What one reference stands for; a name that is none stays as it is written."""
    def of(body: Column) -> Column:
        number = character(F.coalesce(_code(body), F.lit(0)))
        return F.when(F.startswith(body, F.lit("#")), number).otherwise(F.coalesce(_named(ref, body), ref))
    return let(F.rtrim(F.substr(ref, F.lit(2)), F.lit(";")), of)


def unescape_all(texts: Column) -> Column:
    """Texts of an array with their character references decoded, each once: ``&amp;lt;`` becomes ``&lt;``.

    The texts are taken as one, and every different reference in it is replaced at once, the longest first, as a name may
    begin another. A decoded character follows a mark, so it never completes a reference with what stands around it. Marks
    are NUL and a letter: a for an ampersand, b for any other character, c between texts, d for a NUL of the text.
    """
    def pair(ref: Column) -> Column:
        value = let(reference(ref), lambda v: F.when(F.startswith(v, F.lit("&")), F.concat(F.lit("\0a"), F.substr(v, F.lit(2)))).otherwise(
            F.concat(F.lit("\0b"), v)))
        return F.struct((-F.length(ref)).alias("order"), ref.alias("ref"), value.alias("value"))

    def decoded(joined: Column) -> Column:
        refs = F.array_distinct(F.regexp_extract_all(joined, F.lit(REFERENCE), F.lit(0)))
        out = F.aggregate(F.array_sort(F.transform(refs, pair)), joined, lambda t, p: F.replace(t, p["ref"], p["value"]))
        return F.transform(F.split(out, "\0c"), lambda t: F.replace(F.replace(
            F.replace(t, F.lit("\0a"), F.lit("&")), F.lit("\0b"), F.lit("")), F.lit("\0d"), F.lit("\0")))

    def all_of(texts: Column) -> Column:
        whole = let(F.array_join(F.transform(texts, lambda t: F.replace(t, F.lit("\0"), F.lit("\0d"))), "\0c"), decoded)
        # a reference begins with an ampersand: texts without one are as they are
        return F.when(F.exists(texts, lambda t: F.contains(t, F.lit("&"))), whole).otherwise(texts)
    return let(texts, all_of)


def unescape(text: Column) -> Column:
    """One text with its character references decoded."""
    return F.when(text.isNotNull(), unescape_all(F.array(text))[0])
