"""H24 token counting.

Default: whitespace words (``verity.functions.text.token_count``), JVM-side.
BPE counts (as a tokenizer would give) need a vocabulary; ``bpe_token_count``
wraps one in an Arrow-batched pandas UDF, loading the encoder once per
worker process. The tokenizer package is optional and its vocabulary must be
available offline (a cached file or ``TIKTOKEN_CACHE_DIR``), otherwise
``bpe_available`` is False and callers keep the whitespace count.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_ENCODING = "cl100k_base"


@functools.lru_cache(maxsize=4)
def _encoder(name: str):
    import tiktoken  # optional dependency

    return tiktoken.get_encoding(name)


def bpe_available(name: str = DEFAULT_ENCODING) -> bool:
    try:
        _encoder(name)
        return True
    except Exception:  # noqa: BLE001 - missing package or vocabulary (offline)
        return False


def bpe_token_count(col, name: str = DEFAULT_ENCODING) -> Column:
    """BPE token count per string (null -> 0), vectorised over Arrow batches."""
    import pandas as pd

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        enc = _encoder(name)
        return s.fillna("").map(lambda x: len(enc.encode(x))).astype("int64")

    return count(F.col(col) if isinstance(col, str) else col)


def token_counter(col, prefer_bpe: bool = False, name: str = DEFAULT_ENCODING) -> Column:
    """The BPE count when asked for and available, else whitespace words."""
    from verity.functions.text import token_count

    if prefer_bpe and bpe_available(name):
        return bpe_token_count(col, name)
    return token_count(col)
