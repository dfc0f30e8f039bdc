"""Scalars that the built-in functions lack, in Arrow batches, and some that are compositions of these."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Signs that Markdown gives a meaning.
MARKDOWN = r"([\\`*_{}\[\]()#+\-.!|~])"


def _normal(x):
    if isinstance(x, str):
        return unicodedata.normalize("NFC", x).strip()
    if isinstance(x, list):
        return [_normal(v) for v in x]
    if isinstance(x, dict):
        return {k: _normal(v) for k, v in x.items()}
    return x


def _canonical(text: str, f=lambda x: x) -> str | None:
    try:
        return json.dumps(f(json.loads(text)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON with the keys of all its objects in order and no blanks; null for what is no JSON."""
    return s.map(_canonical, na_action="ignore")


@F.pandas_udf(StringType())
def normalised_json(s: pd.Series) -> pd.Series:
    """Canonical JSON whose strings, however deep, are composed (NFC) and without white space at either end."""
    return s.map(lambda t: _canonical(t, _normal), na_action="ignore")


def markdown_escaped(c: Column) -> Column:
    """One line of Markdown that shows the text: white space as one blank, no control characters, signs escaped."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[\x00-\x1f\x7f]", ""))
    html = F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(html, MARKDOWN, r"\\$1")


def diff_normalised(c: Column) -> Column:
    """For comparing two renderings: tags left out, the named entities read, white space as one blank; case stays."""
    out = F.regexp_replace(c, r"</?(?:b|i|em|strong|sub|sup|span|u)\b[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def uuid7(milliseconds: Column, seed: Column) -> Column:
    """A time-ordered identifier: 48 bits of time, version 7, the variant, and bits of a digest of the seed."""
    t, h = F.lpad(F.lower(F.hex(milliseconds)), 12, "0"), F.sha2(seed.cast("string").cast("binary"), 256)
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.substr(variant, F.pmod(F.ascii(F.substring(h, 4, 1)), F.lit(4)) + 1, F.lit(1))
    return F.concat(F.substring(t, 1, 8), F.lit("-"), F.substring(t, 9, 4), F.lit("-7"), F.substring(h, 1, 3), F.lit("-"), nibble, F.substring(h, 5, 3), F.lit("-"), F.substring(h, 8, 12))
