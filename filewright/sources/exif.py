"""Capture time from image bytes: JPEG (APP1) and TIFF, by the public EXIF layout."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "date_time_original string, sub_sec_time_original string"
#: Tags of the Exif directory's pointer, DateTimeOriginal and SubSecTimeOriginal.
EXIF_DIRECTORY, DATE_TIME_ORIGINAL, SUB_SEC_TIME_ORIGINAL = 0x8769, 0x9003, 0x9291


def capture_fields(data) -> tuple[str | None, str | None]:
    """(DateTimeOriginal, SubSecTimeOriginal) of bytes or a memory map, None where missing or malformed."""
    try:
        tiff = _tiff(data or b"")
        if tiff is None:
            return None, None
        order = {b"II": "<", b"MM": ">"}[tiff[:2]]
        entries = _directory(tiff, order, struct.unpack_from(order + "I", tiff, 4)[0])
        if EXIF_DIRECTORY in entries:
            entries |= _directory(tiff, order, struct.unpack_from(order + "I", entries[EXIF_DIRECTORY][2])[0])
        return _text(tiff, order, entries.get(DATE_TIME_ORIGINAL)), _text(tiff, order, entries.get(SUB_SEC_TIME_ORIGINAL))
    except (struct.error, KeyError, IndexError):
        return None, None


def _tiff(data: bytes) -> bytes | None:
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def _directory(tiff: bytes, order: str, at: int) -> dict[int, tuple[int, int, bytes]]:
    n = struct.unpack_from(order + "H", tiff, at)[0]
    found = (struct.unpack_from(order + "HHI4s", tiff, at + 2 + 12 * i) for i in range(n))
    return {tag: (kind, count, value) for tag, kind, count, value in found}


def _text(tiff: bytes, order: str, entry: tuple[int, int, bytes] | None) -> str | None:
    if entry is None or entry[0] != 2:
        return None
    _, count, value = entry
    at = struct.unpack(order + "I", value)[0]
    raw = value[:count] if count <= 4 else tiff[at : at + count]
    return raw.split(b"\0")[0].decode("ascii", "replace")


def _fields(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([capture_fields(x) for x in content], columns=["date_time_original", "sub_sec_time_original"])


def exif(content: Column | str) -> Column:
    """Image bytes to a struct of the two fields."""
    return F.pandas_udf(_fields, SCHEMA)(content)
