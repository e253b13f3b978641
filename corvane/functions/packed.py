"""JSON texts as compressed columns, and back; what can't be read is null."""

from __future__ import annotations

import gzip
import json
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Fixed value: what compressed data begin with.
MAGIC = b"\x1f\x8b"


def _read(blob: bytes | None) -> str | None:
    try:
        text = (gzip.decompress(blob) if blob[:2] == MAGIC else blob).decode("utf-8") if blob else None
        if text is not None:
            json.loads(text)
    except (OSError, EOFError, zlib.error, ValueError, RecursionError):
        return None
    return text


@F.pandas_udf(BinaryType())
def pack_json(texts: pd.Series) -> pd.Series:
    """JSON texts compressed, the same bytes for the same text."""
    return texts.map(lambda t: None if t is None else gzip.compress(t.encode("utf-8"), 9, mtime=0))


@F.pandas_udf(StringType())
def unpack_json(blobs: pd.Series) -> pd.Series:
    """The JSON texts of compressed or plain columns; null for absent, empty or broken ones."""
    return blobs.map(_read)
