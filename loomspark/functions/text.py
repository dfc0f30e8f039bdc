"""Text functions. Offsets are code points, half-open."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

_LINE_END = re.compile("(\r\n|\r|\n)")
LINES = "line_no long, char_start long, char_end long, byte_start long, line string"


def line_table(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line of every text, without its end (CR LF, CR or LF), with running offsets. One pass over a partition, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text], strict=True):
                at = byte = 0
                parts = [] if t is None else [*_LINE_END.split(t), ""]
                for i, (line, end) in enumerate(zip(parts[::2], parts[1::2], strict=True)):
                    rows.append((k, i, at, at + len(line), byte, line))
                    at += len(line) + len(end)
                    byte += len(line.encode()) + len(end)
            yield pd.DataFrame(rows, columns=[key, "line_no", "char_start", "char_end", "byte_start", "line"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInPandas(run, f"{key} {kind}, {LINES}")


def char_windows(documents: DataFrame, size: int = 512, stride: int = 448, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Overlapping windows of size characters; the last one ends with the text. Texts without characters have none."""
    n = F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((n - size) / F.lit(stride)).cast("int") * stride, F.lit(stride)))
    rows = documents.where(n > 0).select(key, text, n.alias("n"), F.explode(starts).alias("s"))
    return rows.select(
        key, F.floor(F.col("s") / stride).cast("long").alias("window_no"), F.col("s").cast("long").alias("char_start"),
        F.least(F.col("s") + size, F.col("n")).cast("long").alias("char_end"), F.expr(f"substring({text}, s + 1, {size})").alias("chunk"),
    )


def folded(c: Column) -> Column:
    """Line ends as line feeds, without white space at either end."""
    return F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composition; there is no built-in function for it."""
    import unicodedata

    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two short strings by longest matching blocks, 0 to 1."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
