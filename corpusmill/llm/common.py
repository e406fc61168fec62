"""What the operators of this subpackage have in common."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize, new_folder, shared_dir, table

__all__ = ["FOLDS", "WordHash", "byte_texts", "fold", "materialize", "new_folder", "ragged", "shared_dir", "small_batches", "table", "with_text"]

#: A document is training data of classifier N unless crc32(doc_id as text) mod 5 has this value.
FOLDS = 5


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


#: Rows of an Arrow batch of texts that suit executors of a few gigabytes: a batch is held in the JVM and in Python at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """For applications: from now on this session sends rows to Python in batches of at most ``BATCH_ROWS``. Operators leave
    the session's settings alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def with_text(df: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """Columns ``keep``, then the text, named by position so that no two have one name."""
    return df.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").cast("string").alias("_text"))


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, one at a time; null: empty."""
    for value in column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column:
        yield value.as_py() or b""


class WordHash(dict):
    """word (bytes) -> signed 64-bit hash, remembered for up to ``most`` words."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        value = value - (1 << 64) if value >> 63 else value
        if len(word) <= 64:
            self[word] = value
        return value

    def each(self, words: Iterable[bytes], n: int) -> np.ndarray:
        """The same hashes, of ``n`` words, none remembered: where many words are rare, hashing costs less than looking up."""
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))
