"""Sku normalisation and decoding of values that the catalog stores as text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import SKU_MARKS
from .compare import fold


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_sku(c: Column | str, marks: Iterable[str] = SKU_MARKS) -> Column:
    """Trimmed sku without its marks, whatever their case."""
    pattern = "(?i)" + "|".join(re.escape(m) for m in marks)
    return F.regexp_replace(F.trim(_col(c)), pattern, "")


def decode_money(c: Column | str) -> Column:
    """Amount of the first entry of ``[{"amount":"9.99","currency":"USD"}]``; null when it is not a number."""
    return F.get_json_object(_col(c), "$[0].amount").try_cast("decimal(18,2)")


def strip_money(c: Column | str) -> Column:
    """The amount as the text it was written with."""
    return F.get_json_object(_col(c), "$[0].amount")


def decode_offset_money(c: Column | str, start: int = 13) -> Column:
    """Amount that begins at a fixed character and ends two places after the first point."""
    text = _col(c)
    length = F.instr(text, ".") + F.lit(3 - start)
    return F.substring(text, F.lit(start), length).try_cast("decimal(18,2)")


def decode_list(c: Column | str) -> Column:
    """``["1","4","adc"]`` as ``1,4,adc``."""
    return F.translate(_col(c), '[]"', "")


def list_items(c: Column | str) -> Column:
    """``["1","4","adc"]`` as an array."""
    return F.from_json(_col(c), "array<string>")


def decode_code(c: Column | str) -> Column:
    """The one code inside ``["code"]``."""
    return F.translate(_col(c), '[]"', "")


def code_map(c: Column | str, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Small fixed code map as a CASE expression: no join, nothing to broadcast. Case and trailing blanks do not count."""
    out = None
    for code, value in mapping.items():
        hit = fold(c) == F.lit(code.lower().rstrip())
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))
