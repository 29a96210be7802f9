"""Elias-Fano coded monotone sequences, built and queried with whole numpy arrays, and memory-mapped from files."""

from __future__ import annotations

import io
import tempfile

import numpy as np

_U = np.uint64
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
#: Place of the k-th set bit of a byte, at 8 * byte + k: a rule, tabulated.
_ONE_AT = np.array([([j for j in range(8) if i >> j & 1] + [8] * 8)[:8] for i in range(256)], dtype=np.uint8).ravel()
_ALL = _U(2**64 - 1)


def _select_in(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit of each word: by halves, then by table."""
    left, place = k.astype(np.int16), np.zeros(len(k), dtype=np.int16)
    for width in (32, 16, 8):
        below = np.bitwise_count(bits & _U((1 << width) - 1)).astype(np.int16)
        beyond = left >= below
        left -= np.where(beyond, below, np.int16(0))
        step = np.where(beyond, np.int16(width), np.int16(0))
        bits = bits >> step.astype(_U)
        place += step
    return place + _ONE_AT[(bits & _U(255)).astype(np.int16) * 8 + left]


def _zeros_before_one(bits: np.ndarray) -> np.ndarray:
    """Zero bits below the lowest set bit; 64 where none is set."""
    return np.bitwise_count((bits & (~bits + _U(1))) - _U(1)).astype(np.int64)


def _words(parts: list[np.ndarray]) -> np.ndarray:
    size = sum(map(len, parts))
    return np.concatenate((*parts, np.zeros(16 - size % 8, dtype=np.uint8))).view("<u8")


class EliasFano:
    """n numbers in ascending order below 2**63. Low bits lie side by side, high parts as a unary bit string, with the number of zeros before each word of it."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.l, self.low, self.high, self.zeros = n, low_bits, low, high, zeros
        self._ones_before: np.ndarray | None = None

    @classmethod
    def build(cls, x: np.ndarray) -> EliasFano:
        x = np.asarray(x, dtype=np.int64)
        n = len(x)
        top = int(x[-1]) if n else 0
        l = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)  # noqa: E741
        step = 1 << 16
        # step * l is a multiple of eight, so that the parts fit byte to byte.
        low = _words([np.packbits(((x[i : i + step, None] >> np.arange(l)) & 1).astype(np.uint8).ravel(), bitorder="little") for i in range(0, n, step)])
        upper = np.zeros(n + (top >> l) + 1, dtype=np.uint8)
        upper[(x >> l) + np.arange(n)] = 1
        high = _words([np.packbits(upper, bitorder="little")])
        ones = _ONES[high.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        return cls(n, l, low, high, np.concatenate(([0], np.cumsum(64 - ones))))

    def parts(self) -> dict[str, np.ndarray]:
        return {"shape": np.array([self.n, self.l]), "low": self.low, "high": self.high, "zeros": self.zeros}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), dtype=np.int64)
        at = i * self.l
        word, shift = at >> 6, (at & 63).astype(_U)
        rest = np.where(shift == 0, _U(0), self.low[word + 1] << ((_U(64) - shift) & _U(63)))
        return (((self.low[word] >> shift) | rest) & _U((1 << self.l) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Places in the bit string of the k-th zeros (or ones)."""
        if ones and self._ones_before is None:
            self._ones_before = np.arange(len(self.zeros)) * 64 - self.zeros
        before = self._ones_before if ones else self.zeros
        word = np.searchsorted(before, k, "right") - 1
        bits = self.high[word] if ones else ~self.high[word]
        return word * 64 + _select_in(bits, k - before[word])

    def _next(self, at: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
        """Places of the k-th zeros (or ones), which are the first ones from the places on: as a rule in the same word."""
        off = (at & 63).astype(_U)
        bits = (self.high[at >> 6] if ones else ~self.high[at >> 6]) >> off
        step = _zeros_before_one(bits)
        far = np.flatnonzero(bits == 0)
        out = at + step
        if len(far):
            out[far] = self._select(k[far], ones)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        return ((self._select(i, True) - i) << self.l) | self._low(i)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th and the next number."""
        at = self._select(i, True)
        after = self._next(at + 1, i + 1, True)
        return ((at - i) << self.l) | self._low(i), ((after - i - 1) << self.l) | self._low(i + 1)

    def find(self, x: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Index of each number, -1 where it isn't there; with low and high, where it isn't at an index from low up to high (exclusive). Fastest for ascending x."""
        x = np.asarray(x, dtype=np.int64)
        out = np.full(len(x), -1, dtype=np.int64)
        if not self.n:
            return out
        hi = x >> self.l
        inside = np.flatnonzero((hi >= 0) & (hi < int(self.zeros[-1])))
        hi, lo = hi[inside], x[inside] & ((1 << self.l) - 1)
        # The numbers with this high part are those between two zeros; their low parts ascend.
        at = np.where(hi > 0, self._select(np.maximum(hi - 1, 0), False) + 1, 0)
        first, end = at - hi, np.minimum(self._next(at, hi, False) - hi, self.n)
        if low is not None:
            first, end = np.maximum(first, low[inside]), np.minimum(end, high[inside])
        while len(inside):
            some = first < end
            inside, lo, first, end = inside[some], lo[some], first[some], end[some]
            middle = (first + end) >> 1
            got = self._low(middle)
            same = got == lo
            out[inside[same]] = middle[same]
            first, end = np.where(got < lo, middle + 1, first), np.where(got > lo, middle, end)
            on = ~same
            inside, lo, first, end = inside[on], lo[on], first[on], end[on]
        return out


def write_array(uri: str, x: np.ndarray) -> None:
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(x.dtype), "fortran_order": False, "shape": x.shape})
    with fs.open_output_stream(path, compression=None) as out:
        out.write(head.getvalue())
        out.write(memoryview(np.ascontiguousarray(x)).cast("B") if x.size else b"")


def mapped(uri: str) -> np.ndarray:
    """The array as a memory map: of the file itself in a local or mounted shared folder, else of a copy that goes with the process."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    fs, path = FileSystem.from_uri(uri)
    if isinstance(fs, LocalFileSystem):
        return np.asarray(np.load(path, mmap_mode="r"))
    with tempfile.NamedTemporaryFile(suffix=".npy") as copy, fs.open_input_stream(path, compression=None) as source:
        while data := source.read(1 << 20):
            copy.write(data)
        copy.flush()
        return np.asarray(np.load(copy.name, mmap_mode="r"))  # the map outlives the name


def write_parts(uri: str, parts: dict[str, np.ndarray]) -> None:
    for name, x in parts.items():
        write_array(f"{uri}.{name}.npy", x)


def mapped_sequence(uri: str) -> EliasFano:
    n, l = np.array(mapped(f"{uri}.shape.npy"))  # noqa: E741
    return EliasFano(int(n), int(l), *(mapped(f"{uri}.{k}.npy") for k in ("low", "high", "zeros")))
