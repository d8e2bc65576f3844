"""Where patterns match in a text, as columns: spans with their surroundings, all on the text's own row, so nothing is shuffled.

A null text has null spans, a text without a match an empty array. Positions count characters from 0. A text's spans cost the square of
their number in additions, which no posting's text makes felt.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# What Java takes for a letter too when it ignores case beyond ASCII.
FOLDED = {"i": "İı", "k": "\u212a", "s": "ſ"}


def led(starts: str, pattern: str, digits: bool = False) -> str:
    """The same pattern, tried only where a match can begin, which spares most places of a text its many alternatives.

    ``starts`` are the first letters of all its alternatives (one to three of each, "_" for a blank); with ``digits`` a match may begin
    with any digit too. Case is ignored in them. Groups keep their numbers.
    """

    def letters(characters: str) -> str:
        return "".join("\\" * (not x.isalnum()) + x for c in characters.replace("_", " ") for x in dict.fromkeys(c + c.upper() + FOLDED.get(c, "")))

    rest = {}
    for start in starts.split():
        rest.setdefault(start[0], []).append("".join(f"[{letters(c)}]" for c in start[1:]))
    # one set of ASCII to leave at once; all else is looked at closely
    left = "".join(f"\\x{k:02x}" for k in range(128) if not (digits and chr(k).isdigit()) and chr(k).lower().replace(" ", "_") not in rest)
    heads = [f"[{letters(c)}]" + ("" if "" in ends else f"(?:{'|'.join(ends)})") for c, ends in rest.items()] + [r"\d"] * digits
    return f"(?=(?-i:[^{left}]))(?=(?-i:{'|'.join(heads)}))(?:{pattern})"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; plain columns inside higher-order functions are computed at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str, before: int = 0, after: int = 0) -> Column:
    """Every match from left to right: start, end, match, and up to so many characters before and after it."""
    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def placed(p: Column) -> Column:
        lengths = F.zip_with(p["gaps"], p["hits"], lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
        return let(F.struct(p["gaps"].alias("gaps"), p["hits"].alias("hits"), lengths.alias("lengths")), found)

    def found(p: Column) -> Column:
        start = lambda i: F.aggregate(F.slice(p["lengths"], F.lit(1), i), F.lit(0), lambda a, b: a + b) + F.length(F.get(p["gaps"], i))
        return F.transform(p["hits"], lambda hit, i: let(F.struct(start(i).alias("start"), hit.alias("match")), span))

    def span(s: Column) -> Column:
        start, end = s["start"], s["start"] + F.length(s["match"])
        low = F.greatest(start - before, F.lit(0))
        around = F.substring(text, low + 1, start - low).alias("before"), F.substring(text, end + 1, F.lit(after)).alias("after")
        return F.struct(start.alias("start"), end.alias("end"), s["match"].alias("match"), *around)

    return F.when(text.isNotNull(), let(pieces, placed))


def first(array: Column) -> Column:
    """The first entry, null for none."""
    return F.get(array, F.lit(0))


def search(text: Column, pattern: str) -> Column:
    """Whether the pattern is found; false for a null text."""
    return F.coalesce(F.rlike(text, F.lit(pattern)), F.lit(False))


def after_last(text: Column, pattern: str) -> Column:
    """What follows the last match, the whole text without one."""
    return F.regexp_replace(text, f"(?s)^.*(?:{pattern})", "")


def before_first(text: Column, pattern: str) -> Column:
    """What precedes the first match, the whole text without one."""
    return F.regexp_replace(text, f"(?s)(?:{pattern}).*$", "")
