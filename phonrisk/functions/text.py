"""Text columns: Unicode forms, whitespace, stamps, escapes and hash-based uniforms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

IDENTIFIER = "^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"
AGGREGATE_ID = "^__.+__$"


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Composed Unicode form. Spark has no built-in, so this is an Arrow UDF."""
    return _nfc(text)


def nfkc(text: Column) -> Column:
    return _nfkc(text)


def squeeze(text: Column) -> Column:
    """Collapse runs of white space and trim."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cue_text(text: Column) -> Column:
    return squeeze(nfc(text))


def recogniser_text(text: Column) -> Column:
    """NFKC, lower case, underscores and punctuation to spaces, collapsed."""
    return squeeze(F.regexp_replace(F.replace(F.lower(nfkc(text)), F.lit("_"), F.lit(" ")), r"(?U)[^\w\s]", " "))


def hash32(key: Column) -> Column:
    """Non-negative 32-bit integer from md5, equal in every engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash60(key: Column) -> Column:
    """Non-negative 60-bit integer from md5, equal in every engine."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def uniform(*parts: Column | str) -> Column:
    """Deterministic uniform in [0, 1) of the given key parts."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]
    return hash32(F.concat_ws(":", *cols)) / F.lit(4294967296.0)


def valid_identifier(ident: Column) -> Column:
    return ident.rlike(IDENTIFIER)


def reserved_identifier(ident: Column) -> Column:
    return ident.rlike(AGGREGATE_ID)


def srt_stamp(seconds: Column) -> Column:
    ms = F.rint(seconds * 1000).cast("long")
    return F.format_string(
        "%02d:%02d:%02d,%03d", (ms / 3600000).cast("long"),
        (ms / 60000).cast("long") % 60, (ms / 1000).cast("long") % 60, ms % 1000,
    )


def ass_stamp(seconds: Column) -> Column:
    cs = F.rint(seconds * 100).cast("long")
    return F.format_string(
        "%d:%02d:%02d.%02d", (cs / 360000).cast("long"), (cs / 6000).cast("long") % 60,
        (cs / 100).cast("long") % 60, cs % 100,
    )


def ass_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))


def risk_colour(risk: Column) -> Column:
    """Three luminance-separated bands (fixed values)."""
    return F.when(risk < 0.35, "&H00FFFFFF").when(risk < 0.60, "&H0080D4FF").otherwise("&H004040FF")
