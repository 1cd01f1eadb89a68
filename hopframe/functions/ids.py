"""Columns parsed from ids, file names and run keys. Every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(pattern: str, value: Column, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit("")).try_cast("int")


def stratum(record_id: Column) -> Column:
    """Text before the first "__", else "unknown"."""
    return F.when(F.instr(record_id, "__") > 0, F.substring_index(record_id, "__", 1)).otherwise(F.lit("unknown"))


def coarse_hop(record_id: Column) -> Column:
    """First digit of the stratum, -1 where it doesn't begin with one."""
    return F.coalesce(_int(r"^([0-9])", stratum(record_id)), F.lit(-1))


def coarse_hop_of(hop_count: Column, record_id: Column) -> Column:
    """hop_count where it is 0 or more, else the id's."""
    return F.coalesce(F.when(hop_count >= 0, hop_count.cast("int")), coarse_hop(record_id))


def questions_slug(stratum_: Column) -> Column:
    """2hop -> 2_hop, 3hop1 -> 3_hop_1; anything else with other characters as underscores."""
    plain = F.regexp_replace(stratum_, r"^(\d+)hop$", "$1_hop")
    numbered = F.regexp_replace(plain, r"^(\d+)hop(\d+)$", "$1_hop_$2")
    return F.when(stratum_.rlike(r"^\d+hop\d*$"), numbered).otherwise(sanitize(stratum_))


def hop(record_id: Column) -> Column:
    """<n>hop at the start of the id, null without it."""
    return _int(r"^(\d+)hop", record_id)


def hop_trimmed(record_id: Column) -> Column:
    return hop(F.trim(record_id))


def hop_strict(record_id: Column) -> Column:
    """<n>hop, an optional number, then "__"."""
    return _int(r"^(\d+)hop(?:\d+)?__", record_id)


def bucket(record_id: Column, buckets: list[str]) -> Column:
    """"<n>hop" where it is one of the buckets, else null."""
    name = F.concat(hop(record_id).cast("string"), F.lit("hop"))
    return F.when(name.isin(buckets), name)


def hop_of_file(name: Column) -> Column:
    return _int(r"questions_(\d+)_hop", name)


def chunk_of_file(name: Column) -> Column:
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(name, r"chunk_(\d+)", 1), F.lit("")), stem)


def strip_clean(stem: Column) -> Column:
    return F.regexp_replace(stem, "_clean$", "")


def sanitize(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_]", "_")


def model_slug(model_id: Column) -> Column:
    """Last path part, dots as underscores, 20 characters."""
    return F.substring(F.translate(F.element_at(F.split(model_id, "/"), -1), ".", "_"), 1, 20)


def model_short_name(model_id: Column, suffixes: list[str]) -> Column:
    out = F.element_at(F.split(model_id, "/"), -1)
    for s in suffixes:
        out = F.when(F.endswith(out, F.lit(s)), F.substr(out, F.lit(1), F.length(out) - len(s))).otherwise(out)
    return out


def cell_key(size: Column, balance: Column, trial: Column) -> Column:
    return F.format_string("size%d_%s_trial%d", size, balance, trial)


def run_key(size: Column, balance: Column, trial: Column, variant: Column, mode: Column) -> Column:
    return F.concat_ws("__", cell_key(size, balance, trial), variant, mode)


def redacted(item_id: Column) -> Column:
    return F.substring(F.sha2(item_id, 256), 1, 12)


def first_id(query_id: Column, own_id: Column, question: Column) -> Column:
    """query_id, else id, else the normalized question; blank ones don't count."""
    from .text import normalize_question

    filled = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.coalesce(filled(query_id), filled(own_id), normalize_question(question))
