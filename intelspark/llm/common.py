"""Helpers shared by the corpus operators: Arrow maps over texts, hashing of byte strings, the labelled split."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fixed evaluation fold: crc32 of the id as text, remainder 2 of 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


_KEPT: dict[str, Callable[[], None]] = {}  # memories of this worker that outlast a task, by owner, and how to let them go


def keep(owner: str, let_go: Callable[[], None]) -> None:
    _KEPT[owner] = let_go


def release(but: str | None = None) -> None:
    """Lets go what tasks of other owners have left in this worker, so that stages do not add up their memories."""
    for owner in [o for o in _KEPT if o != but]:
        _KEPT.pop(owner)()


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``work`` turns an Arrow batch into columns (arrays or lists by name); the result has ``schema``."""
    names = StructType.fromDDL(schema).fieldNames()
    types = _arrow_types(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                yield pa.RecordBatch.from_arrays([_array(out[n], t) for n, t in zip(names, types)], names=names)

    return df.mapInArrow(run, schema)


def map_partition(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, owner: str | None = None) -> DataFrame:
    """Like ``map_batches``, but ``work`` sees all batches of a partition and yields any number of column sets.

    What the ``owner`` keeps in a worker stays there, what others kept goes.
    """
    names = StructType.fromDDL(schema).fieldNames()
    types = _arrow_types(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(owner)
        for out in work(batches):
            yield pa.RecordBatch.from_arrays([_array(out[n], t) for n, t in zip(names, types)], names=names)

    return df.mapInArrow(run, schema)


def _arrow_types(df: DataFrame, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind, from_pandas=False)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts; a null text counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values so that every bit depends on all bits."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, kept and grown by doubling."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        _POWERS[:] = [np.multiply.accumulate(np.full(size, v, U64)) for v in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range data[start:end]; equal strings get equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without space or tab..carriage return."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles of the text in ASCII lower case.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, U64)
    words = range_hashes(data, starts, ends)
    k = min(size, len(words))
    out = np.full(len(words) - k + 1, U64(k))
    for i in range(k):
        out = mix(out * U64(0x9FB21C651E98DF25) + words[i : len(words) - k + 1 + i])
    return np.unique(out)


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each, a single row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of texts cut at ASCII white space: the distinct words, a code per word, and each text's first word.

    Text i has the codes from offsets[i] to offsets[i + 1]; a null text has none.
    """
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = parts.flatten().dictionary_encode()
    offsets = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py() if len(parts) else np.zeros(1, np.int64)
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    if "" in words:
        real = codes != words.index("")
        offsets = np.append(0, np.cumsum(real))[offsets]
        codes = codes[real]
    return words, codes, offsets


def gather(lists: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit lists of the codes one after the other, and where each begins (one more entry for the end)."""
    size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
    first = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(lists), np.int32)
    own = size[codes]
    ends = np.cumsum(own)
    begins = ends - own
    total = int(ends[-1]) if len(ends) else 0
    place = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.arange(total, dtype=place) + np.repeat((first[codes] - begins).astype(place), own)
    return flat[at], np.append(begins, ends[-1] if len(ends) else 0)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch)
