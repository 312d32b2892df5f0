"""Words of Arrow batches: split and told apart in Arrow, so that Python sees each different word of a batch once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split together; bounds memory, not results.
SLICE = 4_000_000


def text_slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """First place and texts of runs of about ``limit`` bytes; nulls are empty texts."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def split(texts: pa.Array, unicode: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of the texts, the place of each word among them in text order, and the number of words of each text.

    Words are cut at the blanks of ASCII (space and 0x09 to 0x0D), or at all of Unicode's.
    """
    listed = (pc.utf8_split_whitespace if unicode else pc.ascii_split_whitespace)(texts)
    coded = listed.flatten().dictionary_encode()
    place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
    # blanks at the ends of a text leave empty words
    full = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        keep = full[place]
        text = np.repeat(np.arange(len(size)), size)
        size, place = np.bincount(text[keep], minlength=len(size)), (np.cumsum(full) - 1)[place[keep]]
    return coded.dictionary.filter(pa.array(full)), place, size


def spread(place: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all items of the named runs (``first`` and ``size`` of each run), one run after the other."""
    n = size[place]
    return np.repeat(first[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
