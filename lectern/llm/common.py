"""Helpers shared by the corpus operators: tables, stored steps, and words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import new_folder, prepare

# White space as the operators mean it: blank, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

MASK = (1 << 64) - 1
# An odd multiplier, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
# Text bytes hashed at once: bounds the memory of the arrays, some 60 times as much, not the size of
# a text. The driver hashes texts too, and what it once held it seldom gives back.
CHUNK_BYTES = 256 << 10


def tuned(spark: SparkSession) -> SparkSession:
    """The settings that memory and disk of the operators depend on.

    Steps are stored, so no shuffle is read again after the query that made it.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a step to the shared folder and read it back: it is not computed twice, its size
    is known to the planner, and a lost executor does not send the job back to the input."""
    spark = df.sparkSession
    folder = new_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def crc_mod(column: str, parts: int) -> Column:
    """crc32 of an id written as text, modulo `parts`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def fold_table(is_word) -> bytes:
    """For `bytes.translate`: A-Z in lower case, and a blank for every byte that is no word byte."""
    out = bytearray(range(256))
    for byte in range(256):
        lower = byte + 32 if 65 <= byte <= 90 else byte
        out[byte] = lower if is_word(lower) else 32
    return bytes(out)


# Words between white space, and words of a-z, 0-9 and everything beyond ASCII.
BY_SPACE = fold_table(lambda b: bytes([b]) not in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
BY_LETTER = fold_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (xor, shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Powers:
    """Powers of BASE and of its inverse, kept as far as chunks need them; a longer text has its own."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(self.up):
            return self.up[:n], self.down[:n]
        up = np.full(n, BASE, dtype=np.uint64)
        down = np.full(n, INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        if n <= CHUNK_BYTES + 2:
            self.up, self.down = up, down
        return up, down


POWERS = Powers()


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES each; a longer text is a chunk of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], fold: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and where each text's words begin.

    The second array has one more entry than there are texts.
    """
    (hashes,), begins = word_and_prefix_hashes(texts, fold, ())
    return hashes, begins


def word_and_prefix_hashes(
    texts: list[bytes], fold: bytes, prefixes: tuple[int, ...]
) -> tuple[list[np.ndarray], np.ndarray]:
    """As `word_hashes`, with the hashes of the words' first bytes; a shorter word is its own prefix.

    A hash is a polynomial over bytes, taken from one running sum over the whole
    chunk, so no word becomes a Python object.
    """
    data = np.frombuffer(b" ".join(texts).translate(fold) + b" ", dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    first_byte = np.concatenate(([0], np.cumsum(lengths + 1)))
    edges = np.diff((data != 32).astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = POWERS.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    scale, before = down[starts], sums[starts]
    hashes = []
    for stops in (ends, *(np.minimum(ends, starts + n) for n in prefixes)):
        size = (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        hashes.append(mix((sums[stops] - before) * scale + size))
    return hashes, np.searchsorted(starts, first_byte)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a column of texts; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("").cast(pa.binary()).to_pylist()
