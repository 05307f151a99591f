"""Vectorised text kernels shared by the operators of this subpackage.

All of them work on whole Arrow batches: a string column becomes one array of
code points plus row offsets, so every step costs a few numpy passes over the
characters and no Python code runs per character.  Batches are cut by character
count (``MAX_CHARS``), never texts; a single longer text makes its own slice.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

MAX_CHARS = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """True for every code point that is a Unicode letter or digit."""
    return np.frombuffer(bytes(chr(i).isalnum() for i in range(0x110000)), dtype=bool)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _ODD), np.full(n, _ODD_INV)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64."""
    size = 1 << max(16, (n + 1).bit_length())
    up, down = _powers(size)
    return up[: n + 1], down[: n + 1]


def slices(batch: pa.RecordBatch, columns: list[str]):
    """Cut a batch so that no slice holds more than MAX_CHARS bytes of the text columns."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for c in columns:
        col = batch.column(c)
        off = np.frombuffer(col.buffers()[1], dtype=np.int32 if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else np.int64)
        sizes += np.diff(off[col.offset : col.offset + len(col) + 1].astype(np.int64))
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > 3 * MAX_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def codepoints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points uint32, row starts int64 with the end appended); null counts as empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    if n == 0 or col.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint32), np.zeros(n + 1, dtype=np.int64)
    data = memoryview(col.buffers()[2])[int(off[0]) : int(off[-1])]
    cp = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    raw = np.frombuffer(data, dtype=np.uint8)
    before = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return cp, before[off - off[0]]


def only(cp: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept code points and their row starts."""
    before = np.zeros(len(cp) + 1, dtype=np.int64)
    np.cumsum(keep, out=before[1:])
    return cp[keep], before[starts]


def letters(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    cp, starts = codepoints(col)
    return only(cp, starts, letter_table()[cp])


def rows_of(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def prefix_hash(cp: np.ndarray) -> np.ndarray:
    """Prefix sums from which any segment's hash can be taken."""
    up, _ = powers(len(cp))
    out = np.zeros(len(cp) + 1, dtype=np.uint64)
    np.cumsum(mix(cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], out=out[1:])
    return out


def segment_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of cp[start:end] for arrays of bounds, independent of where it stands."""
    _, down = powers(len(prefix))
    h = (prefix[end] - prefix[start]) * down[start]
    return mix(h ^ ((end - start).astype(np.uint64) * _MIX2))


def window_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k code points (also across rows; see inside())."""
    n = len(prefix) - 1 - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    _, down = powers(len(prefix))
    return mix((prefix[k:] - prefix[:-k]) * down[:n])


def inside(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """True where a window of k beginning here lies within one row."""
    ends = np.repeat(starts[1:], np.diff(starts))[:n]
    return np.arange(len(ends)) + k <= ends


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each window of w values, in log2(w) passes."""
    f = np.minimum if least else np.maximum
    if len(x) < w:
        return x[:0]
    cur, have = x, 1
    while have * 2 <= w:
        cur = f(cur[:-have], cur[have:])
        have *= 2
    rest = w - have
    return f(cur[:-rest], cur[rest:]) if rest else cur


def anchor_order(hashes: np.ndarray) -> np.ndarray:
    """What anchors are the least by."""
    return (hashes >> np.uint64(33)).astype(np.uint32) + np.uint32(1)


def anchors(hashes: np.ndarray, starts: np.ndarray, k: int, w: int) -> np.ndarray:
    """Content-defined positions: those whose k-window hash is the least of some w
    neighbouring ones within the row.  Any two texts that share w + k - 1 letters in
    a row share an anchor there."""
    n = len(hashes)
    if n < w:
        return np.zeros(0, dtype=np.int64)
    x = anchor_order(hashes)
    low = sliding(x, w, True)
    low = np.where(inside(starts, k + w - 1, len(low)), low, np.uint32(0))
    padded = np.zeros(n + w - 1, dtype=np.uint32)
    padded[w - 1 : w - 1 + len(low)] = low
    return np.flatnonzero(sliding(padded, w, False) == x)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def table(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def row_hash(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return segment_hash(prefix_hash(cp), starts[:-1], starts[1:])


def windows(text: str, k: int) -> np.ndarray:
    """Hashes of the windows of k code points of one text, in order."""
    return window_hash(prefix_hash(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)), k)


def jaccard(one: np.ndarray, two: np.ndarray) -> float:
    """Likeness of two sorted arrays of distinct hashes."""
    both = len(one) + len(two) - len(np.unique(np.concatenate([one, two]))) if len(one) and len(two) else 0
    return both / max(1, len(one) + len(two) - both)


def common_windows(mine: np.ndarray, other: np.ndarray, k: int) -> list[int]:
    """Merged [start, end, ...] of the windows of k code points, given in order, that the other text holds."""
    at = np.flatnonzero(np.isin(mine, other))
    if not len(at):
        return []
    gap = np.flatnonzero(at[1:] > at[:-1] + k)
    start, end = at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)] + k
    return np.stack([start, end], axis=1).ravel().tolist()


def shingle_sets(text: str, k: int = 5) -> frozenset:
    t = "".join(filter(str.isalnum, text or ""))
    return frozenset(t[i : i + k] for i in range(len(t) - k + 1))
