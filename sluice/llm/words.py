"""Words of whole Arrow batches as flat arrays, for the operators that work on them in NumPy."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_arrow(texts):
    """texts (an Arrow string array; null as empty) -> distinct words as an Arrow array, the place among them of every
    word, and where each text's words start, plus the end. Words are runs of anything but ASCII white space."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    at = np.asarray(words.offsets)
    at = at - at[0]
    coded = words.flatten().dictionary_encode()
    place = np.asarray(coded.indices).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # around leading and trailing white space
        real = place != empty
        at = np.concatenate([[0], np.cumsum(real)])[at]
        place = place[real]
    return coded.dictionary, place, at


def split(texts):
    """As split_arrow, with the distinct words as a list."""
    distinct, place, at = split_arrow(texts)
    return distinct.to_pylist(), place, at


def hashes(distinct: list[str]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))


def _is_letter(code: int) -> bool:
    """Whether a code point is a letter or a mark on one."""
    import unicodedata

    return unicodedata.category(chr(code))[0] in "LM"


def _letters() -> np.ndarray:
    return np.array([_is_letter(c) for c in range(0x10000)])  # the first plane


class Runs:
    """The runs of letters in words: `codes` flat, with `start`, `size` and `owner` (a word's place) of each run."""

    letters: np.ndarray | None = None

    def __init__(self, distinct: list[str]):
        if Runs.letters is None:
            Runs.letters = _letters()
        joined = "\n".join([*distinct, ""])
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        plain = np.minimum(self.codes, 0xFFFF).astype(np.int64)
        letter = Runs.letters[plain]
        if len(far := np.flatnonzero(self.codes > 0xFFFF)):
            points, back = np.unique(self.codes[far], return_inverse=True)
            letter[far] = np.array([_is_letter(int(c)) for c in points])[back]
        edge = np.diff(np.concatenate([[0], letter.astype(np.int8), [0]]))
        self.start = np.flatnonzero(edge == 1)
        self.size = np.flatnonzero(edge == -1) - self.start
        self.owner = np.cumsum(self.codes == 10)[self.start] if len(self.start) else self.start
        self.letter = letter
