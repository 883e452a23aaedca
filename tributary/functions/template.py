"""Message templates: the constant shape of a line with its variable parts masked.

Rules, in order, on each position of a line's first line: a run of control
bytes; white space; a quoted span; else a token up to the next white space or
control byte. A token is peeled of punctuation and its core is masked by the
first rule that fits: time, UUID, address, path (each segment for itself),
key=value, number with unit, opaque id.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Punctuation that is peeled off a token.
PEELED = "()[]{}<>\"'`,;$#@!?|"

_QUOTES = "\"'`"
_DATE = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}(?::\d{2})?(?:[.,]\d+)?(?:[+-]\d{2}:?\d{2})?Z?"
_TIME = re.compile(rf"(?a:{_DATE}|{_CLOCK}|{_DATE}[T ]{_CLOCK})")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_IPV4 = re.compile(r"(?a:\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?)")
_IPV6 = re.compile(r"[0-9a-fA-F:]+")
_NUMBER = re.compile(r"(?a:[+-]?\d+(?:[.,]\d+)*)(%|[A-Za-z]{0,3})")
_ID = re.compile(r"[A-Za-z0-9_-]+")
_SCAN = re.compile(r"(?P<ctl>[\x00-\x08\x0a-\x1f\x7f]+)|(?P<space>[ \t]+)|(?P<token>[^\x00-\x20\x7f]+)")
_LOOKS = re.compile(r"[0-9./=:-]")


def _opaque(text: str, least: int) -> bool:
    return len(text.encode()) >= least and bool(_ID.fullmatch(text)) and bool(re.search("[0-9]", text))


def _value(core: str) -> str:
    if _TIME.fullmatch(core):
        return "<ts>"
    if _UUID.fullmatch(core):
        return "<uuid>"
    if _IPV4.fullmatch(core) or core.count(":") >= 2 and _IPV6.fullmatch(core):
        return "<ip>"
    if "/" in core and len(core) > 1:
        return "/".join(map(_segment, core.split("/")))
    key, eq, value = core.partition("=")
    if eq and key and value:
        masked = _value(value)
        return f"{key}={masked}" if masked != value else f"{key}=<id>" if _opaque(value, 3) else core
    if m := _NUMBER.fullmatch(core):
        return "<num>" + m[1]
    if _opaque(core, 8) and re.search("[A-Za-z]", core):
        return "<id>"
    return core


def _peeled(text: str) -> tuple[str, str, str]:
    """Punctuation before, the core, and punctuation after."""
    low, high = 0, len(text)
    while low < high and text[low] in PEELED:
        low += 1
    while high > low and text[high - 1] in PEELED:
        high -= 1
    return text[:low], text[low:high], text[high:]


def _segment(text: str) -> str:
    """A part of a path, masked inside its punctuation."""
    before, part, after = _peeled(text)
    return before + _part(part) + after if part else text


def _part(part: str) -> str:
    if _UUID.fullmatch(part):
        return "<uuid>"
    if _TIME.fullmatch(part):
        return "<ts>"
    if _opaque(part, 8) and re.search("[A-Za-z]", part):
        return "<id>"
    m = _NUMBER.fullmatch(part)
    return "<num>" + m[1] if m else part


def _token(text: str) -> str:
    if not _LOOKS.search(text):
        return text
    before, core, after = _peeled(text)
    return before + (_value(core) if core else "") + after


def template(line: str) -> str:
    """Template of one line."""
    out, at, n = [], 0, len(line)
    while at < n:
        c = line[at]
        if c in _QUOTES:
            end = line.find(c, at + 1)
            if end > at + 1:
                out.append(f"{c}<str>{c}")
                at = end + 1
                continue
        m = _SCAN.match(line, at)
        if m["ctl"]:
            out.append("<ctl>")
        elif m["space"]:
            out.append(m[0])
        else:
            out.append(_token(m[0]))
        at = m.end()
    return "".join(out)


def template_of(message: str | None, raw: str | None = None) -> str:
    """Template of a message's first line; of the raw text if the message is empty."""
    return template((message or raw or "").split("\n", 1)[0].removesuffix("\r"))


def template_id(pattern: str) -> str:
    return hashlib.sha256(pattern.encode()).hexdigest()[:12]


@F.pandas_udf(StringType())
def _template_udf(text: pd.Series) -> pd.Series:
    known: dict = {}
    return text.map(lambda t: known[t] if t in known else known.setdefault(t, template_of(t)), na_action="ignore")


def text_choice(message: Column, raw: Column) -> Column:
    return F.when(F.coalesce(message, F.lit("")) != "", message).otherwise(raw)


def template_column(text: Column) -> Column:
    return _template_udf(text)


def id_column(pattern: Column) -> Column:
    """First 12 hexadecimal digits of the template's SHA-256."""
    return F.substring(F.sha2(pattern.cast("binary"), 256), 1, 12)
