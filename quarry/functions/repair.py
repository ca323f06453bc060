"""Model responses that should be JSON: decoding what is there, saving what is cut."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.MULTILINE)
_PAIR = re.compile(r'"(\d{1,3})"\s*:\s*"')
_OPEN = re.compile(r"[{\[]")

REPAIRED = StructType([StructField("translations", MapType(StringType(), StringType())), StructField("strict_ids", ArrayType(StringType())), StructField("salvaged_ids", ArrayType(StringType()))])


def values(text: str):
    """Top-level JSON values one after the other, whatever stands between them, until one can't be decoded."""
    decoder, at = json.JSONDecoder(), len(text) - len(text.lstrip())
    while at < len(text):
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            return
        yield value
        opening = _OPEN.search(text, at)
        if not opening:
            return
        at = opening.start()


def cut_pairs(text: str):
    """Complete ``"number": "string"`` pairs anywhere; a value that was read is never searched again."""
    at = 0
    while match := _PAIR.search(text, at):
        at = match.end()
        try:
            value, at = scanstring(text, at)
        except ValueError:
            continue
        yield match.group(1), value


def repair_one(raw: str | None, expected: list[str]) -> tuple[dict[str, str], list[str], list[str]]:
    """Translations by expected id, the ids that strict decoding gave, and those that were saved. Blank values don't count."""
    text, wanted = _FENCE.sub("", (raw or "").strip()).strip(), set(expected)
    merged: dict = {}
    for value in values(text):
        if isinstance(value, dict):
            merged.update(value)
    strict = {k: v for k, v in merged.items() if k in wanted and isinstance(v, str) and v.strip()}
    saved: dict[str, str] = {}
    if len(strict) < len(wanted):
        saved = {k: v for k, v in cut_pairs(text) if k in wanted and k not in strict and v.strip()}
    return strict | saved, sorted(strict), sorted(saved)


@F.pandas_udf(REPAIRED)
def repair(raw: pd.Series, expected: pd.Series) -> pd.DataFrame:
    found = [repair_one(r, [] if e is None else list(e)) for r, e in zip(raw, expected)]
    return pd.DataFrame({"translations": [f[0] for f in found], "strict_ids": [f[1] for f in found], "salvaged_ids": [f[2] for f in found]})


_FLAT_PAIR = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*"((?:[^"\\]|\\.)*)"', re.S)


def pairs_one(raw: str | None) -> dict[str, str]:
    """The texts of a flat JSON object; or, where that fails, all ``"key": "value"`` pairs as they are written."""
    try:
        value = json.loads(raw or "")
        if isinstance(value, dict):
            return {str(k): v for k, v in value.items() if isinstance(v, str)}
    except ValueError:
        pass
    return dict(_FLAT_PAIR.findall(raw or ""))


@F.pandas_udf(MapType(StringType(), StringType()))
def pairs(raw: pd.Series) -> pd.Series:
    return raw.map(pairs_one)
