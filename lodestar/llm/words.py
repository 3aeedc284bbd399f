"""Words of texts as Arrow and NumPy arrays: maximal runs of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and words: those of text k are words[offsets[k]:offsets[k + 1]]. A null text has none."""
    # large offsets, so that the words of one batch may be longer than 2 GB together
    listed = pc.ascii_split_whitespace(pc.fill_null(pc.cast(texts, pa.large_string()), ""))
    words = listed.flatten()
    real = np.asarray(pc.not_equal(words, ""), dtype=bool)  # white space at either end of a text leaves an empty word
    before = np.concatenate([[0], np.cumsum(real)])
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(listed), dtype=np.int64))])
    return before[ends], words.filter(pa.array(real))


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for every word, equal for equal words only, and the words of the numbers."""
    coded = words.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


def joined(words: pa.Array, offsets: np.ndarray) -> list[bytes]:
    """The words between each two offsets, joined by one space, in UTF-8."""
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words)
    return pc.cast(pc.binary_join(lists, pa.scalar(" ", words.type)), pa.large_binary()).to_pylist()


def by_size(sizes: np.ndarray, most: int):
    """(first, last) of consecutive rows whose sizes sum to `most` at most, or of one larger row."""
    first, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield first, k
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)
