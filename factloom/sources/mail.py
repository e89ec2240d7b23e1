"""Mail as envelopes, blobs that may be gzipped, and sheets as prompt text."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def envelopes_of_mail(mails: DataFrame, connector: str) -> DataFrame:
    """Parsed mails (uid, message_id, from_addr, to_addrs, subject, text, html, date, attachments) as envelopes in auto mode.

    The external id is the connector's: its message id, or uid-N where there is none.
    """
    own = F.concat(F.lit(f"{connector}:"), F.coalesce(F.nullif(F.trim("message_id"), F.lit("")), F.concat(F.lit("uid-"), F.col("uid").cast("string"))))
    none = F.lit(None).cast("string")
    return mails.select(F.lit("email").alias("channel"), own.alias("external_id"), none.alias("org"), F.col("to_addrs").alias("recipients"), none.alias("handle"), F.col("from_addr").alias("sender"), "subject", "text", "html", F.col("date").alias("received_at"), "attachments", F.lit("auto").alias("mode"))


def dmarc_failed(headers: Column | str) -> Column:
    """The authentication results say dmarc=fail."""
    c = F.col(headers) if isinstance(headers, str) else headers
    return F.coalesce(F.lower(c).rlike(r"\bdmarc\s*=\s*fail\b"), F.lit(False))


def accepted_mail(mails: DataFrame, headers: str = "authentication_results") -> DataFrame:
    """Mails whose sender isn't refuted by DMARC."""
    return mails.where(~dmarc_failed(headers))


def _plain(content: bytes | None) -> bytes | None:
    return gzip.decompress(content) if content and content[:2] == b"\x1f\x8b" else content


@F.pandas_udf(T.BinaryType())
def _unzipped(contents: pd.Series) -> pd.Series:
    return contents.map(_plain, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def _zipped(contents: pd.Series) -> pd.Series:
    # no time stamp, so that equal contents stay equal
    return contents.map(lambda x: min(gzip.compress(x, mtime=0), x, key=len), na_action="ignore")


def blob_content(c: Column | str) -> Column:
    """A blob's bytes, unzipped where they are gzip."""
    return _unzipped(c)


def stored_content(c: Column | str) -> Column:
    """A blob's bytes as they are stored: gzipped where that is smaller."""
    return _zipped(c)


def sheet_text(rows: DataFrame, columns: list[tuple[str, str]], sheet: str = "sheet", order: str = "ord", most_rows: int = 200, most_chars: int = 600_000) -> DataFrame:
    """sheet, text, truncated: each sheet's header and first rows as lines of cells with bars between (rows: sheet, ord, data)."""
    header = " | ".join(label for _, label in columns)
    line = F.concat_ws(" | ", *(F.coalesce(F.element_at("data", key), F.lit("")) for key, _ in columns))
    own = rows.groupBy(sheet).agg(F.count("*").alias("n"))
    first = rows.where(F.col(order) < most_rows).groupBy(sheet).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("lines"))
    text = F.trim(F.concat_ws("\n", F.lit(header), F.array_join(F.transform("lines", lambda x: x["l"]), "\n")))
    out = own.join(first, sheet).withColumn("text", text)
    return out.select(sheet, F.substring("text", 1, most_chars).alias("text"), ((F.col("n") > most_rows) | (F.length("text") > most_chars)).alias("truncated"))
