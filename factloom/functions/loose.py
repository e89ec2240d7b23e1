"""Functions that no expression can say: JSON out of a model's reply, and the SQL names of the rest."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DECODER = json.JSONDecoder()
#: A string, kept as it is, or a comma with nothing but a closing bracket after it.
_STRING_OR_LAST_COMMA = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])')


def _values(text: str) -> Iterator[object]:
    """The text as one JSON value, then what can be decoded at each opening bracket."""
    try:
        yield json.loads(text)
    except ValueError:
        pass
    for m in re.finditer(r"[{\[]", text):
        try:
            yield _DECODER.raw_decode(text, m.start())[0]
        except ValueError:
            continue


def loose_json(text: str | None) -> str | None:
    """A reply's JSON, canonical; null where there is none. Fences, prose around it and trailing commas are forgiven."""
    if text is None:
        return None
    parts = text.split("```")
    body = re.sub(r"(?i)^json\b", "", parts[1].strip()) if len(parts) > 2 else text
    for source in (body, _STRING_OR_LAST_COMMA.sub(lambda m: m[1] or "", body)):
        for value in _values(source.strip()):
            return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return None


@F.pandas_udf(T.StringType())
def _loose_json(replies: pd.Series) -> pd.Series:
    return replies.map(loose_json, na_action="ignore").where(replies.notna(), None)


def parse_loose(c: Column | str) -> Column:
    """loose_json of a column, in Arrow batches."""
    return _loose_json(c)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def centroid_fold(embedding: pd.Series, created_at: pd.Series, id: pd.Series) -> Any:
    """vault_centroid_fold(embedding, created_at, id): a group's running mean in order, its memory 200.

    An SQL name for groups that one task can hold; ``resolve.fold_centroids`` has
    no such bound.
    """
    import numpy as np

    order = pd.DataFrame({"at": created_at, "id": id}).sort_values(["at", "id"], na_position="last").index
    mean, n = None, 0
    for v in embedding.loc[order]:
        if v is None or not len(v) or (mean is not None and len(v) != len(mean)):
            continue
        weight = min(n, 200)
        v = np.asarray(v, float)
        mean, n = (v if mean is None else (mean * weight + v) / (weight + 1)), n + 1
    return None if mean is None else mean.tolist()


def register(spark: SparkSession) -> None:
    """Installs the SQL functions: vault_chunk_text (a table function), vault_loose_json, vault_centroid_fold (an aggregate), vault_strip_accents, vault_fold_plural."""
    from .sections import chunk_text
    from .text import ACCENTED, PLAIN

    spark.udtf.register("vault_chunk_text", chunk_text)
    spark.udf.register("vault_centroid_fold", centroid_fold)
    spark.udf.register("vault_loose_json", _loose_json)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vault_strip_accents(s STRING) RETURNS STRING RETURN translate(s, {quoted(ACCENTED)}, {quoted(PLAIN)})")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION vault_fold_plural(s STRING) RETURNS STRING RETURN CASE WHEN length(s) > 4 AND s RLIKE '(s|x|z|ch|sh)es$' THEN regexp_replace(s, 'es$', '') WHEN length(s) > 3 AND s RLIKE '[^s]s$' THEN regexp_replace(s, 's$', '') ELSE s END")
