"""Byte-level BPE encoding and decoding with the ranks of a tokenizer file.

The driver reads the rank file, under a megabyte, and sends it along; a worker builds the
encoder once. Long texts are encoded in stretches cut before a space or line feed that follows
a non-space: no match of the splitting pattern crosses such a place, and none looks behind it,
so the ids are those of the whole text. Texts are read where they lie; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters after which a long text is cut at the next safe place.
STRETCH = 1 << 16

_SAFE = re.compile(r"(?<=\S)[ \n]")
_built: dict[str, object] = {}


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in stretches of about ``size`` characters; one without a safe place stays whole."""
    start = 0
    while len(text) - start > size:
        place = _SAFE.search(text, start + size)
        if place is None:
            break
        yield text[start : place.start()]
        start = place.start()
    yield text[start:]


def _encoding(pattern: str, ranks: bytes):
    import tiktoken

    key = hashlib.sha256(pattern.encode() + ranks).hexdigest()
    if key not in _built:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        names = [str(i) for i in range(max(table.values()) + 1)]
        _built[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={}), names
    return _built[key]


class BytePairs:
    """A tokenizer from a rank file: columns of ids and of decoded bytes. Null texts count as empty."""

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str):
        with open(rank_file, "rb") as ranks:
            self._ranks: Broadcast = spark.sparkContext.broadcast(ranks.read())
        self._pattern = pattern

    def encode(self, text: Column) -> Column:
        """Token ids of a text."""
        ranks, pattern = self._ranks, self._pattern

        @F.pandas_udf("array<int>")
        def ids(texts: pd.Series) -> pd.Series:
            encoding, _ = _encoding(pattern, ranks.value)
            return texts.map(lambda t: _ids(encoding, t))

        return ids(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        """The bytes that ids stand for; they need not be a whole number of characters."""
        ranks, pattern = self._ranks, self._pattern

        @F.pandas_udf("binary")
        def decoded(lists: pd.Series) -> pd.Series:
            encoding, _ = _encoding(pattern, ranks.value)
            return lists.map(lambda x: encoding.decode_bytes(list(x)))

        return decoded(F.coalesce(ids, F.array().cast("array<int>")))

    def round_trip(self, text: Column) -> Column:
        """A struct of n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256.

        Text is encoded and its ids decoded within the task, so that ids don't travel.
        """
        ranks, pattern = self._ranks, self._pattern

        @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
        def digests(texts: pd.Series) -> pd.DataFrame:
            encoding, names = _encoding(pattern, ranks.value)
            rows = []
            for text in texts:
                said, back, n = hashlib.sha256(), hashlib.sha256(), 0
                for stretch in stretches(text):
                    ids = encoding.encode_ordinary(stretch)
                    if ids:
                        said.update(("," if n else "").encode() + ",".join([names[i] for i in ids]).encode())
                        back.update(encoding.decode_bytes(ids))
                        n += len(ids)
                rows.append((n, said.hexdigest(), back.hexdigest()))
            return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

        return digests(F.coalesce(text, F.lit("")))


def _ids(encoding, text: str) -> list[int]:
    return [i for stretch in stretches(text) for i in encoding.encode_ordinary(stretch)]
