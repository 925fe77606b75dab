"""Text column expressions (TXT1-TXT3).  All JVM-side; no Python per row."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whitespace_class() -> str:
    """Regex class of exactly the characters Python's ``str.isspace`` accepts
    (what ``str.strip()`` and ``str.split()`` use), written with ``\\x{..}``
    escapes that Java regex and RE2 both read."""
    cps = [c for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    runs, start, prev = [], cps[0], cps[0]
    for c in cps[1:]:
        if c != prev + 1:
            runs.append((start, prev))
            start = c
        prev = c
    runs.append((start, prev))
    part = lambda a, b: f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}"
    return "[" + "".join(part(a, b) for a, b in runs) + "]"


WS = _whitespace_class()
WS_CHARS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
STRIP_PATTERN = f"\\A{WS}+|{WS}+\\z"
SPLIT_PATTERN = f"{WS}+"
NON_WS_JAVA = r"(?U)[^\s\x1c-\x1f]"

# fixed values of the text rule (TXT1): longest word kept, bounds of the cleaned length,
# and the characters removed before the length is measured
MAX_WORD_CHARS = 20
MIN_CLEAN_CHARS = 2
MAX_CLEAN_CHARS = 200
CLEAN_DROP_CHARS = ",\"'()\t _"
# the same set as one regex class (a regex pass is cheaper than Spark's translate)
CLEAN_DROP_CLASS = "[" + "".join("\\" + ch if ch in "\\[]^-" else ch for ch in CLEAN_DROP_CHARS) + "]+"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: ``btrim`` with the whole whitespace set
    (plain ``trim`` only strips spaces); linear, no regex."""
    return F.btrim(c, F.lit(WS_CHARS))


def _rep(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def normalise_text_steps(c: Column) -> Column:
    """Step 1 of TXT1: the ordered replacements, strip and lower-casing."""
    s = _rep(c, "\n", "")
    s = _rep(s, "\t", " ")
    s = _rep(s, "-", " ")
    s = F.lower(strip_ws(s))
    s = _rep(s, "\\", " ")
    s = _rep(s, "/", " ")
    s = _rep(s, "  ", " ")
    s = _rep(s, '":', "")
    return _rep(s, ",", " ")


def _rejects(s: Column) -> tuple[Column, Column]:
    # a whitespace-separated word longer than the limit == a run of limit+1
    # non-whitespace characters.  Java's Unicode \s plus \x1c-\x1f is exactly
    # Python's isspace set (checked over all code points in the tests); the
    # built-in class is ~5x cheaper per character than the spelled-out one.
    long_word = s.rlike(f"{NON_WS_JAVA}{{{MAX_WORD_CHARS + 1}}}")
    cleaned = F.length(strip_ws(F.regexp_replace(s, CLEAN_DROP_CLASS, "")))
    return long_word, cleaned


def normalise_text(c: Column | str) -> Column:
    """TXT1: normalised text, or null when a word is too long or the cleaned
    text is too short / too long.  (One expression; on large texts prefer
    ``with_normalised_text``, which evaluates the steps once.)"""
    c = F.col(c) if isinstance(c, str) else c
    s = normalise_text_steps(c)
    long_word, cleaned = _rejects(s)
    return F.when(~long_word & cleaned.between(MIN_CLEAN_CHARS, MAX_CLEAN_CHARS), s)


def with_normalised_text(df, src: str, dst: str | None = None):
    """TXT1 as staged projections: the normalised text is computed once and
    the two checks read it (a single CASE expression would repeat the
    replacement chain three times)."""
    dst = dst or src
    tmp, lw, cl = "__txt1_s", "__txt1_long", "__txt1_len"
    staged = df.withColumn(tmp, normalise_text_steps(F.col(src)))
    long_word, cleaned = _rejects(F.col(tmp))
    staged = staged.withColumns({lw: long_word, cl: cleaned})
    ok = ~F.col(lw) & F.col(cl).between(MIN_CLEAN_CHARS, MAX_CLEAN_CHARS)
    return staged.withColumn(dst, F.when(ok, F.col(tmp))).drop(tmp, lw, cl)


def render_lines(lines: Sequence[tuple[str, Column | str, str]]) -> Column:
    """TXT2: one text per item from ``(label, column, mode)`` lines, each
    printed as ``label: value.`` and joined by newlines.

    Mode ``optional`` drops the line when the value is null (a field that was
    simplified away); ``required`` and ``none`` print ``None`` for a null.
    """
    parts = []
    for label, col, mode in lines:
        v = F.col(col) if isinstance(col, str) else col
        v = v.cast("string")
        if mode in ("required", "none"):
            v = F.coalesce(v, F.lit("None"))
        elif mode != "optional":
            raise ValueError(f"unknown line mode {mode!r}")
        parts.append(F.concat(F.lit(f"{label}: "), v, F.lit(".")))
    return F.concat_ws("\n", *parts)


def python_list_text(arr: Column) -> Column:
    """Text of a Python list of strings, e.g. ``['a', 'b']``."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
                    F.lit("]"))


def render_properties(props: Sequence[tuple[str, Column | str]]) -> Column:
    """TXT3: ``name: value`` lines for the non-empty properties only
    (null, empty string and empty array are left out)."""
    parts = []
    for name, col in props:
        v = F.col(col) if isinstance(col, str) else col
        parts.append((name, v))
    out = []
    for name, v in parts:
        out.append(F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v)))
    return F.concat_ws("\n", *out)


def property_value(v: Column, kind: str = "string") -> Column:
    """Helper for TXT3: text of a value, null when Python would find it falsy."""
    if kind == "string":
        return F.when(v != "", v)
    if kind == "array":
        return F.when(F.size(v) > 0, python_list_text(v))
    if kind == "number":
        return F.when(v != 0, v.cast("string"))
    raise ValueError(kind)
