"""Notes, pads, paths."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lattice import SNAP_MAX, phrase_offset


def event_note(slot: str, raw: Column, origin: Column, final: Column) -> Column:
    """What became of an event's raw bar, with its offsets from the 8, 16 and 32 bar lattices."""
    off = [phrase_offset(raw, origin, p) for p in (8, 16, 32)]
    head = F.format_string(f"{slot}: raw bar %d, off8=%+d, off16=%+d, off32=%+d, ", raw, *off)
    tail = F.when(final != raw, F.format_string("snapped to bar %d", final)).when(F.abs(off[0]) > SNAP_MAX, F.lit("off-phrase (unsnapped)")).otherwise(F.format_string("at bar %d", final))
    return F.concat(head, tail)


def minutes_seconds(t: Column) -> Column:
    m = F.floor(t / 60)
    return F.format_string("%d:%05.2f", m, t - m * 60)


def pad_letter(n: Column) -> Column:
    return F.char(F.lit(65) + n)


def pad_number(letter: Column) -> Column:
    return F.ascii(letter) - 65


def file_url_path(url: Column, scheme: str = "file") -> Column:
    """The decoded path of a URL of one scheme, else null.  Plus signs stay; unencoded spaces are allowed."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    held = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)) == scheme
    return F.when(held, F.url_decode(F.regexp_replace(path, r"\+", "%2B")))


def nfc(text: Column | str) -> Column:
    """Unicode normal form C; Spark has no built-in for it."""
    return F.pandas_udf(_nfc, "string")(text)


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def list_items(s: Column) -> Column:
    """The non-empty trimmed items of a comma-separated list."""
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")
