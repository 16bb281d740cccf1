"""Blockwise suffix sorting with a difference cover, for suffixes cut to a fixed length.

Positions of the cover sample (those whose remainder modulo PERIOD is in COVER) are ranked by their next
PERIOD bytes first. Suffixes are then sorted one bucket of similar beginnings at a time: by PERIOD bytes,
and where those tie by sample ranks. For any two positions there is a shift below PERIOD that moves both
onto the sample, and steps of PERIOD stay on it, so two suffixes are compared by a few ranks and by their
last bytes. Memory beside the text: its words, one rank per sample, and one bucket."""

import numpy as np

from reportlake.llm.arrays import words_at

#: A perfect difference set modulo 31: every remainder is a difference of two members.
PERIOD = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
BUCKET = 1 << 17
#: Where the words lie that together hold PERIOD bytes.
WORDS = (0, 8, 16, PERIOD - 8)

_place = np.full(PERIOD, -1)
_place[COVER] = np.arange(len(COVER))
#: SHIFT[a, b]: the smallest shift that moves remainders a and b onto the cover.
SHIFT = np.array([[min(d for d in range(PERIOD) if _place[(a + d) % PERIOD] >= 0 <= _place[(b + d) % PERIOD])
                   for b in range(PERIOD)] for a in range(PERIOD)])


def by_period(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of some positions by their next PERIOD bytes, and where in it the bytes change."""
    last = len(words) - 1
    keys = [words[np.minimum(at + w, last)] for w in WORDS]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(at), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, new


def sample_ranks(words: np.ndarray) -> np.ndarray:
    """Rank of the next PERIOD bytes of every cover position, at index (p // PERIOD) * len(COVER) + place."""
    at = (np.arange(0, len(words), PERIOD)[:, None] + COVER).ravel()
    real = at < len(words)
    order, new = by_period(words, at[real])
    ranks = np.zeros(len(at), np.int32)
    ranks[np.flatnonzero(real)[order]] = np.cumsum(new)
    return ranks


def compare(words, ranks, a, b, size: int) -> np.ndarray:
    """-1, 0 or 1 for pairs of suffixes cut to `size` bytes whose first PERIOD bytes are equal."""
    shift = SHIFT[a % PERIOD, b % PERIOD]
    a, b, end_a, end_b = a + shift, b + shift, a + size, b + size
    rank_a = a // PERIOD * len(COVER) + _place[a % PERIOD]
    rank_b = b // PERIOD * len(COVER) + _place[b % PERIOD]
    out = np.zeros(len(a), np.int8)
    for step in range(size // PERIOD):
        at = step * len(COVER)
        open_ = np.flatnonzero((out == 0) & (a + (step + 1) * PERIOD <= end_a))
        if not len(open_):
            break
        x, y = ranks[rank_a[open_] + at], ranks[rank_b[open_] + at]
        out[open_] = (x > y).astype(np.int8) - (x < y)
    for word in WORDS:
        open_ = np.flatnonzero(out == 0)
        x, y = words[end_a[open_] - PERIOD + word], words[end_b[open_] - PERIOD + word]
        out[open_] = (x > y).astype(np.int8) - (x < y)
    return out


def sort_bucket(words, ranks, at, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, and True where one equals that before it. Ties of the
    first PERIOD bytes are resolved by three-way partition around a member of each tie, all ties at once."""
    order, new = by_period(words, at)
    at = at[order]
    equal = np.zeros(len(at), bool)
    group = np.cumsum(new)
    low = np.flatnonzero(new)
    active = np.flatnonzero(np.diff(np.append(low, len(at)))[group - 1] > 1)
    group = group[active]
    while len(active):
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        count = np.diff(np.append(head, len(active)))
        pivot = np.repeat(at[active[head + count // 2]], count)
        side = compare(words, ranks, at[active], pivot, size)
        key = np.repeat(np.arange(len(head)), count) * 3 + side
        turn = np.argsort(key, kind="stable")
        at[active] = at[active[turn]]
        key, side = key[turn], side[turn]
        first = np.r_[True, key[1:] != key[:-1]]
        equal[active[(side == 0) & ~first]] = True
        start = np.flatnonzero(first)
        more = (np.diff(np.append(start, len(key)))[np.cumsum(first) - 1] > 1) & (side != 0)
        active, group = active[more], key[more]
    return at, equal


def buckets(words: np.ndarray, at: np.ndarray, limit: int = BUCKET):
    """The positions bucket by bucket; suffixes that begin with the same word share a bucket."""
    keys = words[at]
    if len(at) <= limit:
        yield at
        return
    edges = np.unique(np.sort(keys[:: max(1, len(keys) // 4096)])[:: max(1, 4096 * limit // len(keys))])
    which = np.searchsorted(edges, keys, "right")
    for k in range(len(edges) + 1):
        mine = at[which == k]
        if len(mine):
            yield mine


def sorted_suffixes(text: np.ndarray, at: np.ndarray, size: int):
    """For every bucket: its positions in suffix order, and True where one equals that before it in its
    first `size` bytes. All positions must have `size` bytes of text; `size` is at least PERIOD."""
    words = words_at(text)
    ranks = sample_ranks(words)
    for bucket in buckets(words, at):
        yield sort_bucket(words, ranks, bucket, size)


def repeated(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The positions of `at`, sorted, whose first `size` bytes another position of `at` shares."""
    found = [np.zeros(0, np.int64)]
    for order, equal in sorted_suffixes(text, at, size):
        shared = equal.copy()
        shared[:-1] |= equal[1:]
        found.append(order[shared])
    return np.sort(np.concatenate(found))
