"""Strings, paths and file names as Column expressions. Nulls give null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_char(c: Column, ch: str) -> Column:
    return F.btrim(c, F.lit(ch))


def left_trim(c: Column, ch: str) -> Column:
    return F.ltrim(c, F.lit(ch))


def right_trim(c: Column, ch: str) -> Column:
    return F.rtrim(c, F.lit(ch))


def remove_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.lit(bool(prefix)) & c.startswith(prefix), F.substring(c, len(prefix) + 1, 2**31 - 1)).otherwise(c)


def remove_suffix(c: Column, suffix: str) -> Column:
    return F.when(F.lit(bool(suffix)) & c.endswith(suffix), F.left(c, F.length(c) - len(suffix))).otherwise(c)


def split(c: Column, delimiter: str) -> Column:
    """All pieces between a literal delimiter, empty ones kept."""
    return F.split(c, re.escape(delimiter), -1)


def split_at(c: Column, delimiter: str, position: int) -> Column:
    """Piece at a 0-based position, negative ones from the end; null out of range."""
    return F.try_element_at(split(c, delimiter), F.lit(position + 1 if position >= 0 else position))


def replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def regex_match(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs anywhere."""
    return c.rlike(pattern)


def filename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def dirname(c: Column) -> Column:
    """Everything before the last '/'; '.' where there is none."""
    return F.when(c.contains("/"), F.regexp_extract(c, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def extension(c: Column) -> Column:
    """From the last '.' of the file name; the compound forms of compressed files whole; '' for none."""
    return F.regexp_extract(filename(c), r"(?i)((\.nii|\.tar)\.gz|\.tar\.bz2|\.[^.]*)$", 1)


def basename(c: Column) -> Column:
    """File name without its extension."""
    name = filename(c)
    return F.left(name, F.length(name) - F.length(extension(c)))


def join_path(*parts: Column) -> Column:
    trimmed = [F.regexp_replace(p, r"/+$", "") if i == 0 else F.regexp_replace(p, r"^/+|/+$", "") for i, p in enumerate(parts)]
    return F.array_join(F.array_compact(F.array(*[F.nullif(t, F.lit("")) for t in trimmed])), "/")


def file_label(c: Column) -> Column:
    """<label> of <label>_<sample>[_<suffix>].<ext>."""
    return F.nullif(F.regexp_extract(basename(c), r"^([0-9]+)_([0-9]+)", 1), F.lit("")).cast("int")


def file_sample(c: Column) -> Column:
    return F.nullif(F.regexp_extract(basename(c), r"^([0-9]+)_([0-9]+)", 2), F.lit("")).cast("long")


def file_suffix(c: Column) -> Column:
    return F.regexp_extract(basename(c), r"^[0-9]+_[0-9]+_(.*)$", 1)


def normal_path(c: Column) -> Column:
    """One spelling of a path: '/' only, no './', no doubled '/', no blanks around, lower case."""
    slashed = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"[\\/]+", "/")
    return F.lower(F.regexp_replace(slashed, r"^(\./)+", ""))
