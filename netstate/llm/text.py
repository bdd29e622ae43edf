"""Whole texts as byte arrays: word borders, hashes and n-grams of many texts in one vectorised step.

Arrow hands a batch of strings over as one byte buffer with offsets. The helpers cut a batch into runs of whole texts of
about a megabyte, so that temporary arrays stay small. A text longer than that is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
#: Bytes of words made of digits, a-z and anything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def runs(column: pa.Array | pa.ChunkedArray, limit: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, text borders) of consecutive whole texts; a null text is an empty one."""
    first = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.fill_null("") if chunk.null_count else chunk
        wide = pa.types.is_large_string(chunk.type)
        _, borders, content = chunk.buffers()
        count = len(chunk)
        if not count:
            continue
        offsets = np.frombuffer(borders, np.int64 if wide else np.int32)[chunk.offset : chunk.offset + count + 1]
        offsets = offsets.astype(np.int64)
        data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
        i = 0
        while i < count:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield first + i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        first += count


def spans(data: np.ndarray, borders: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the longest stretches of bytes for which `inside` is true, within a text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    yes = inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = yes[:-1]
    before[borders[:-1][borders[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = yes[1:]
    after[borders[1:][borders[1:] > 0] - 1] = False
    starts = np.flatnonzero(yes & ~before)
    ends = np.flatnonzero(yes & ~after) + 1
    return starts, ends, np.searchsorted(borders, starts, "right") - 1


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, extended on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * RUN_BYTES)
            steps = np.full(size, _BASE, np.uint64)
            back = np.full(size, _INVERSE, np.uint64)
            steps[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(steps), np.multiply.accumulate(back)
        return self.up, self.down


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(0xD6E8FEB86659FD93)))


def characters(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, with A-Z and the accented capitals of Latin-1 in lower case, and the text borders among them."""
    first = (data & 0xC0) != 0x80
    counts = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=counts[1:])
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(codes) != counts[-1]:  # not well-formed: bytes stand for characters
        return LOWER[data].astype(np.uint32), borders
    capital = ((codes >= 65) & (codes <= 90)) | ((codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7))
    return codes + np.where(capital, np.uint32(32), np.uint32(0)), counts[borders]


def gram_hashes(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each character; the last n - 1 positions are left out."""
    size = max(0, len(codes) - n + 1)
    value = np.full(size, n * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        value = (value ^ codes[k : k + size]) * np.uint32(0x01000193)
        value ^= value >> np.uint32(15)
    return ((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def unit_hash(*columns: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def hash_sample(
    rows: DataFrame, key: str, group: str, per_group: int, seed: int = 7, texts: DataFrame | None = None
) -> DataFrame:
    """Each group cut to about `per_group` rows, chosen by a hash of the key. Meant for labelled rows only.

    The number of groups is the number of labels. Twice `per_group` keys a group are the limit. With `texts`, a table of keys
    and further columns, the keys are chosen without those columns and sent to the scan of `texts`, so that no text of
    another row is exchanged.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    if not counts:
        return rows.limit(0)
    share = F.coalesce(
        *[F.when(F.col(group) == F.lit(value), F.lit(min(1.0, per_group / n))) for value, n in counts.items()], F.lit(0.0)
    )
    wanted = rows.where(unit_hash(key, seed=seed) < share)
    if texts is None:
        return wanted.limit(2 * per_group * len(counts))
    keys = wanted.select(key, group).limit(2 * per_group * len(counts)).distinct()
    chosen = rows.sparkSession.createDataFrame(keys.collect(), keys.schema)
    return texts.join(F.broadcast(chosen), key)
