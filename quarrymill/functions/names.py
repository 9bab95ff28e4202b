"""Field names: normalisation at plan time, unique names, sensitive names, file and data set names."""

from __future__ import annotations

import re
import unicodedata
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.text import MAX_NAME, trimmed

# Fixed value: characters that file names don't have.
UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'

# Field names that count as sensitive.
SENSITIVE_NAMES = (
    "password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "private_key", "access_token",
    "refresh_token", "credit_card", "card_number", "cvv", "ssn",
)


def normalized(name: object) -> str:
    """Lower case with ``_`` for white space and for all but letters, digits, ``_`` and ``-``."""
    text = unicodedata.normalize("NFKC", str("" if name is None else name).replace("\0", "").strip()[:MAX_NAME])
    text = re.sub(r"\s+", "_", text)
    text = "".join(c if c in "_-" or unicodedata.category(c)[0] in "LN" else "_" for c in text)
    text = re.sub(r"_+", "_", text).strip("-").lower()
    if not text:
        return "field"
    return (f"field_{text}" if re.match(r"[0-9]", text) else text)[:MAX_NAME]


def unique(names: list[str]) -> list[str]:
    """A later name that is taken gets ``_2``, ``_3`` and so on."""
    used: set[str] = set()
    out = []
    for name in names:
        new, n = name, 2
        while new in used:
            new, n = f"{name}_{n}", n + 1
        used.add(new)
        out.append(new)
    return out


def normalized_all(names: list[str]) -> list[str]:
    return unique([normalized(n) for n in names])


def plain(name: str, lower: bool = False) -> str:
    """The lighter rule of file and service records: trimmed, white space as ``_``; lower case for the service."""
    text = re.sub(r"\s+", "_", name.replace("\0", "").strip())[:MAX_NAME]
    return text.lower() if lower else text


def sensitive(names: list[str]) -> list[str]:
    """The distinct names that are sensitive, in order."""
    found = [n for n in names if re.sub(r"\s+", "_", n.strip().lower()) in SENSITIVE_NAMES]
    return list(dict.fromkeys(found))


def file_name(name: str | None, default: str = "dataset", most: int = 120) -> str:
    """A name for a file: each character that file systems refuse and each run of white space becomes ``_``."""
    text = re.sub(r"\s+", "_", re.sub(UNSAFE, "_", (name or "").strip()))[:most]
    return text or default


def dataset_name(name: str | None, most: int = 150, today: date | None = None) -> str:
    """A data set's name, cut; a dated one where there is none."""
    return (name or "").replace("\0", "").strip()[:most] or f"Dataset {(today or date.today()).isoformat()}"


def output_name(name: str | None, form: str) -> str:
    return f"{file_name(name)}.{form.lower()}"


def file_name_of(c: Column, default: str = "dataset", most: int = 120) -> Column:
    """``file_name`` of a column."""
    safe = F.regexp_replace(F.regexp_replace(trimmed(F.coalesce(c, F.lit(""))), UNSAFE, "_"), r"\s+", "_")
    return F.coalesce(F.nullif(F.substring(safe, 1, most), F.lit("")), F.lit(default))
