"""Documents to numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_array(text: Column, opens: bool = False) -> Column:
    """Lines of a text, split at \\n only. A final \\n opens no further line; an empty or null text has none.

    With opens every \\n opens a line, so the last one may be empty and an empty text is one empty line.
    """
    if opens:
        return F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))
    whole = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)  # split once, not to be looked at after
    return F.when(text != "", F.split(whole, "\n", -1)).otherwise(F.array().cast("array<string>"))


def lines(docs: DataFrame, key: str | list[str] = "doc_id", text: str = "text", opens: bool = False) -> DataFrame:
    """(key..., line_no, line); line numbers start at 1. A narrow generator: no shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    return docs.select(
        *keys, F.posexplode(line_array(F.col(text), opens)).alias("__pos", "line")
    ).select(*keys, (F.col("__pos") + 1).cast("bigint").alias("line_no"), "line")


def not_binary(text: Column) -> Column:
    """No NUL among the first 512 bytes."""
    head = F.decode(F.substring(F.encode(F.substring(text, 1, 512), "UTF-8"), 1, 512), "ISO-8859-1")
    return F.instr(head, "\x00") == 0
