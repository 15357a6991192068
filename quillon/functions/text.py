"""Text functions on columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache
def _folding() -> tuple[str, str]:
    """(from, to) for translate(): characters of the basic plane that decompose to one ASCII letter or digit and
    combining marks become that letter; the marks themselves, which have no counterpart in `to`, go."""
    single, base = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        parts = [c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F]
        if len(parts) == 1 and parts[0] != chr(code) and parts[0].isascii() and parts[0].isalnum():
            single.append(chr(code))
            base.append(parts[0].lower())
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(single + marks), "".join(base)


def fold(text: Column) -> Column:
    """Lower case without accents. Text of one byte a character has none."""
    old, new = _folding()
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(F.lower(text), old, new))


@lru_cache
def pictographs() -> str:
    """Pattern of a pictograph with what belongs to it: variation selectors, and further pictographs behind joiners. Java 17 has
    no class for the property Extended_Pictographic, so its ranges are taken from a library that has."""
    import regex

    one, ranges = regex.compile(r"\p{Extended_Pictographic}"), []
    for code in range(0x20000):
        if not 0xD800 <= code < 0xE000 and one.match(chr(code)):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    any_of = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" if a < b else f"\\x{{{a:X}}}" for a, b in ranges) + "]"
    return rf"{any_of}(?:\x{{FE0F}}|\x{{200D}}{any_of})*"


@lru_cache
def _about_pictographs() -> str:
    """Class of few wide ranges that hold every pictograph: most characters are seen to be none by it, without the many narrow ones."""
    import re

    ranges = []
    for a, b in re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", pictographs().split("]")[0]):
        first, last = int(a, 16), int(b or a, 16)
        if ranges and first - ranges[-1][1] <= 1024:
            ranges[-1][1] = last
        else:
            ranges.append([first, last])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def wrap_pictographs(text: Column, before: str, after: str) -> Column:
    """Every pictograph between before and after; digits, flags of letters and skin tones are none. Text of one byte a
    character has none."""
    wrapped = F.regexp_replace(text, f"(?={_about_pictographs()})({pictographs()})", f"{before}$1{after}")
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(wrapped)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once for each row however often it stands in use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Tokens of a free-text answer: folded, everything but a-z, 0-9 and blanks taken as a blank. Null stays null."""
    words = F.split(F.regexp_replace(fold(text), "[^a-z0-9 ]+", " "), " +")
    return F.array_remove(words, "")


def digest(*parts: Column | str) -> Column:
    """SHA-256 in hex of the parts joined by |; null if a part is null, where concat_ws alone would skip it."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat(*[x for c in columns for x in (c, F.lit("|"))][:-1]), 256)


def escape_html(text: Column) -> Column:
    """& first, then <; nothing else."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def clock(seconds: Column) -> Column:
    """Seconds as m:ss; negative ones count as 0."""
    whole = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def or_default(column: Column, default) -> Column:
    """The column, or default where it is null, zero or an empty string."""
    empty = F.lit("") if isinstance(default, str) else F.lit(0)
    return F.coalesce(F.nullif(column, empty), F.lit(default))


def first_equals(text: Column) -> tuple[Column, Column]:
    """Key and rest of a string, split at its first "="; without one, all is key and the rest is empty."""
    at = F.instr(text, "=")
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(F.lit(""))


def normalise_path(path: Column) -> Column:
    """Forward slashes, without empty and "." segments; ".." takes back the segment before it, if there is one."""
    segments = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != "."))
    none = F.array().cast("array<string>")
    step = lambda done, s: F.when(s == "..", F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)).otherwise(F.concat(done, F.array(s)))
    return F.array_join(F.aggregate(segments, none, step), "/")


def match_spans(text: Column, pattern: str) -> Column:
    """Array of found, start (from 0) of every match of pattern in text, in order; null text gives null.

    What lies between the matches is split off by the same pattern, so a match is placed by all that comes before it, however
    often its own text stands elsewhere. The pattern must not match an empty string.
    """
    gaps = F.split(text, pattern, -1)
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<found:string,start:int>>").alias("spans"))

    def step(s: Column, m: Column) -> Column:
        start = s["end"] + F.length(F.get(gaps, F.size(s["spans"])))
        return F.struct((start + F.length(m)).alias("end"), F.concat(s["spans"], F.array(F.struct(m.alias("found"), start.alias("start")))).alias("spans"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), none, step, lambda s: s["spans"])
