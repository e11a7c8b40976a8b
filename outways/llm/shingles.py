"""Sets of word shingles as 64-bit hashes, for batches of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once; longer texts are hashed alone.
SLICE_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of BASE and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, SLICE_BYTES + 1024)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, factor in (("up", BASE), ("down", inverse)):
            table = np.full(size, factor, "u8")
            table[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def _hashed(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every shingle, not yet distinct."""
    joined = np.frombuffer(b" ".join(texts) + b" ", "u1")
    word = ~_SEPARATOR[joined]
    edges = np.diff(word.astype("i1"), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    up, down = _power_tables(len(joined))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(joined) + 1, "u8")
        np.add.accumulate((joined.astype("u8") + np.uint64(1)) * up[: len(joined)], out=sums[1:])
        words = mixed((sums[ends] - sums[starts]) * down[starts])
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    n = len(words) - width + 1
    found_owner, found = [], []
    with np.errstate(over="ignore"):
        if n > 0:
            inside = owner[:n] == owner[width - 1 :]
            h = np.zeros(n, "u8")
            for j in range(width):
                h = mixed(h * BASE + words[j : j + n])
            found_owner.append(owner[:n][inside])
            found.append(h[inside])
        counts = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(counts) - counts
        for i in np.flatnonzero((counts > 0) & (counts < width)):
            h = np.full(1, counts[i], "u8")
            for w in words[first[i] : first[i] + counts[i]]:
                h = mixed(h * BASE + w)
            found_owner.append(np.array([i]))
            found.append(h)
    return np.concatenate(found_owner), np.concatenate(found)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): text i's distinct shingles are ``hashes[offsets[i]:offsets[i + 1]]``, ascending.

    A-Z are lower-cased; words are runs of bytes other than space and 09 to 0D. A text of fewer
    words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    raw = [(t or "").encode().lower() for t in texts]
    sizes, parts, at = np.zeros(len(raw), "i8"), [], 0
    while at < len(raw):
        end, held = at, 0
        while end < len(raw) and (end == at or held + len(raw[end]) <= SLICE_BYTES):
            held += len(raw[end]) + 1
            end += 1
        owner, h = _hashed(raw[at:end], width)
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
        sizes[at:end] = np.bincount(owner[fresh], minlength=end - at)
        parts.append(h[fresh])
        at = end
    return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(parts) if parts else np.zeros(0, "u8")


def set_keys(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, "u8")
        np.cumsum(mixed(hashes ^ np.uint64(0xD6E8FEB86659FD93)), out=sums[1:])
        n = np.diff(offsets).astype("u8")
        return mixed((sums[offsets[1:]] - sums[offsets[:-1]]) * BASE + n).view("i8")


def chunks(batches: Iterator, rows: int = 2_000) -> Iterator:
    """Arrow batches in pieces of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
