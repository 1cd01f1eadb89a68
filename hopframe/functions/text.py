"""Text normalization and step parsing as native expressions.

\\s and \\w are Unicode-aware ((?U)); lines end at all of CR, LF, VT, FF, FS, GS, RS, NEL, LS and PS.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
WHITE = r"(?U)\s+"
# The 32 ASCII punctuation characters and the English articles of answer normalization.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = r"(?U)\b(a|an|the)\b"
THINK = r"(?s)<think>.*?</think>\s*"
ENUMERATOR = r"^\s*\d+\.\s*"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_question(text: Column) -> Column:
    """Trimmed, lower case, white space as single spaces; null as empty."""
    return F.coalesce(F.regexp_replace(F.lower(_trim(text)), WHITE, " "), F.lit(""))


def normalize_step(step: Column) -> Column:
    """Trimmed and lower case, without characters other than letters, digits, _, # and white space; not trimmed again."""
    return F.regexp_replace(F.regexp_replace(F.lower(_trim(step)), r"(?U)[^\w\s#]", ""), WHITE, " ")


def tokenize(text: Column) -> Column:
    """Lower-case words between white space, punctuation kept."""
    return F.filter(F.split(F.lower(text), WHITE), lambda t: t != "")


def normalize_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation, then articles as spaces, then white space collapsed."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return _trim(F.regexp_replace(F.regexp_replace(bare, ARTICLES, " "), WHITE, " "))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_answer(text), " "), lambda t: t != "")


def lines(text: Column) -> Column:
    """Trimmed non-blank lines."""
    return F.filter(F.transform(F.split(text, LINE_END), _trim), lambda t: t != "")


def split_steps(text: Column) -> Column:
    """Lines without their "<n>. "; a line that is only that is dropped."""
    return F.filter(F.transform(lines(text), lambda t: F.regexp_replace(t, ENUMERATOR, "")), lambda t: t != "")


def step_count(text: Column) -> Column:
    return F.size(split_steps(text))


def open_think(text: Column) -> Column:
    return F.regexp_count(text, F.lit("<think>")) > F.regexp_count(text, F.lit("</think>"))


def strip_artifacts(text: Column, strip_think: bool = True, truncate_at: list[str] | None = None) -> Column:
    out = F.regexp_replace(text, THINK, "") if strip_think else text
    for marker in truncate_at or []:
        out = F.substring_index(out, marker, 1)
    return out


def post_process(text: Column, strip_think: bool = True, truncate_at: list[str] | None = None) -> Column:
    return _trim(strip_artifacts(text, strip_think, truncate_at))


def completed_step_count(text: Column, strip_think: bool = True, truncate_at: list[str] | None = None) -> Column:
    """Steps in finished lines: none while a think block is open, nothing after the last line feed."""
    done = strip_artifacts(text, strip_think, truncate_at)
    ended = F.regexp_extract(done, r"(?s)^(.*)\n", 1)
    return F.when(open_think(text) | ~F.contains(done, F.lit("\n")), F.lit(0)).otherwise(step_count(ended))


def trim_to_steps(text: Column, most: int) -> Column:
    """The first lines that are steps, enumerators kept."""
    if most <= 0:
        raise ValueError("the number of step lines must be positive")
    real = F.filter(lines(text), lambda t: F.regexp_replace(t, ENUMERATOR, "") != "")
    return F.array_join(F.slice(real, 1, most), "\n")


def steps_of_list(steps: Column) -> Column:
    """Trimmed non-blank items; enumerators stay."""
    return F.filter(F.transform(steps, _trim), lambda t: t != "")


def steps_of_structs(steps: Column, field: str = "question") -> Column:
    return steps_of_list(F.transform(steps, lambda s: s[field]))


def first_filled(*arrays: Column) -> Column:
    """The first array with an item."""
    return F.coalesce(*(F.when(F.size(a) > 0, a) for a in arrays))


def join_steps(steps: Column, separator: str = "\n") -> Column:
    return F.array_join(steps_of_list(steps), separator)


def clean_brackets(text: Column) -> Column:
    return F.regexp_replace(text, r"\[([^\]]*)\]", "$1")


def refine_line(line: Column) -> Column:
    """Text before the first tab without brackets; null where blank."""
    return F.nullif(_trim(clean_brackets(F.substring_index(line, "\t", 1))), F.lit(""))


def normalize_step_line(line: Column) -> Column:
    return _trim(F.translate(_trim(F.regexp_replace(line, ENUMERATOR, "")), "’", "'"))


def clean_answer(text: Column, take_first_line: bool, prefixes: list[str], most: int) -> Column:
    """struct(answer, truncated): first non-blank line, first matching prefix off, cut to `most` characters (0: whole)."""
    value = _trim(F.coalesce(text, F.lit("")))
    if take_first_line:
        value = F.coalesce(F.get(lines(value), F.lit(0)), F.lit(""))
    out = value
    for p in reversed([p for p in prefixes if p]):
        out = F.when(F.startswith(F.lower(value), F.lit(p.lower())), _trim(F.substr(value, F.lit(len(p) + 1)))).otherwise(out)
    long = (F.length(out) > most) if most > 0 else F.lit(False)
    return F.struct(F.when(long, _trim(F.substr(out, F.lit(1), F.lit(max(most, 1))))).otherwise(out).alias("answer"), long.alias("truncated"))


def is_filled(value: Column, kind: str = "string") -> Column:
    return F.coalesce(F.size(value) > 0 if kind == "array" else F.length(value) > 0, F.lit(False))


def break_steps(steps: Column) -> Column:
    """White space collapsed, #k as @@k@@, blanks dropped."""
    flat = F.filter(F.transform(steps, lambda s: F.regexp_replace(_trim(s), WHITE, " ")), lambda s: s != "")
    return F.transform(flat, lambda s: F.regexp_replace(s, r"#(\d+)", "@@$1@@"))


def break_string(steps: Column) -> Column:
    return F.array_join(break_steps(steps), " @@SEP@@ ")


def format_completion(steps: Column, bracket: bool = True, numbered: bool = True) -> Column:
    """Steps as lines; bare #k as [#k]; numbered from 1."""
    s = F.transform(steps, lambda t: F.regexp_replace(t, r"(?<!\[)#(\d+)", r"[#$1]")) if bracket else steps
    if numbered:
        s = F.transform(s, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t))
    return F.array_join(s, "\n")
