"""Recompression: rounds that name runs and pairs of symbols alike wherever they occur.

Symbols of level 0 are the words. In each round every maximal run of one symbol gets a name made of
the symbol and the run's length, then every pair of a "left" and a "right" symbol (a bit of the
symbol's name decides) gets a name made of both. Names are 64-bit hashes of their parts, so all
tasks give the same name to the same words without asking each other.

For every symbol its context is kept: the range of words that fixes how the symbol came about. A
window of words that holds the context of a symbol has this symbol inside wherever the window
occurs. So equal windows have equal inner symbols, and each window is filed under one of them."""

import numpy as np

from reportlake.llm import arrays

LEVELS = 2
INDEX = np.uint64((1 << 28) - 1)
RUN = np.uint64(0xE7037ED1A0B428DB)
PAIR = np.uint64(0x8EBC6AF09C88C6E3)


def rounds(hashes: np.ndarray, first: np.ndarray, levels: int = LEVELS):
    """Per level: names, and context [low, high) in words, of all symbols. `first` has the first word
    of each document and the number of words; contexts that need a document's end lie outside it."""
    n = len(hashes)
    head = np.zeros(n + 1, bool)
    head[first] = True
    start = np.arange(n)
    name, low, high, head = hashes, start, start + 1, head[:n]
    for level in range(1, levels + 1):
        # Runs of one symbol within a document.
        new = head.copy()
        new[1:] |= name[1:] != name[:-1]
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(name)))
        ends = at + length
        stop = np.append(start[at][1:], n)
        tail = np.append(head, True)[ends]
        left = np.where(head[at], start[at] - 1, low[at - 1])
        right = np.where(tail, stop + 1, high[np.minimum(ends, len(name) - 1)])
        run = arrays.mix(name[at] ^ (length.astype(np.uint64) * RUN))
        name, low, high, head, start = np.where(length > 1, run, name[at]), left, right, head[at], start[at]
        # Pairs of a left and a right symbol within a document.
        is_left = arrays.mix(name + np.uint64(level)) & np.uint64(1) == 0
        inner = np.append(~head[1:], False)
        pair = np.zeros(len(name), bool)
        pair[:-1] = is_left[:-1] & ~is_left[1:]
        pair &= inner
        second = np.concatenate([[False], pair[:-1]])
        alone = ~pair & ~second
        last = ~inner
        next_high = np.append(high[1:], 0)
        prev_low = np.concatenate([[0], low[:-1]])
        high2 = np.where(pair, next_high, np.where(alone & is_left, np.where(last, stop + 1, next_high), high))
        low2 = np.where(alone & ~is_left, np.where(head, start - 1, prev_low), low)
        both = arrays.mix(arrays.mix(name * PAIR) + np.append(name[1:], np.uint64(0)))
        name = np.where(pair, both, name)[~second]
        low, high, head, start = low2[~second], high2[~second], head[~second], start[~second]
        yield name, low, high


def anchors(hashes: np.ndarray, first: np.ndarray, windows: np.ndarray, size: int, levels: int = LEVELS):
    """For the windows of `size` words that start at `windows` (sorted): the number of their anchor,
    and the anchors' keys (hash of symbol and context). The anchor is the symbol of the highest
    level with a context inside the window, the least by hash; a window without one is its own."""
    of = np.full(len(windows), -1, np.int64)
    keys = []
    made = 0
    for level, (name, low, high) in reversed(list(enumerate(rounds(hashes, first, levels), 1))):
        open_ = np.flatnonzero(of < 0)
        if not len(open_):
            break
        start = windows[open_]
        count = lambda x, w: np.cumsum(np.bincount(np.maximum(x, 0), minlength=len(hashes) + 2))[w]
        begin = count(low + 1, start)
        end = count(high, start + size)
        some = end > begin
        open_, begin, end = open_[some], begin[some], end[some]
        if not len(open_):
            continue
        best = (arrays.mix(name ^ np.uint64(level)) & ~INDEX) | np.arange(len(name), dtype=np.uint64)
        tables, width = [best], 1
        span = end - begin
        while 2 * width <= span.max():
            best = np.minimum(best[:-width], best[width:])
            tables.append(best)
            width *= 2
        chosen = np.empty(len(open_), np.uint64)
        for k, table in enumerate(tables):
            fit = (span >= 1 << k) & (span < 2 << k)
            chosen[fit] = np.minimum(table[begin[fit]], table[end[fit] - (1 << k)])
        symbol = (chosen & INDEX).astype(np.int64)
        used = np.zeros(len(name), bool)
        used[symbol] = True
        number = np.cumsum(used) - 1
        of[open_] = made + number[symbol]
        used = np.flatnonzero(used)
        context = arrays.span_hashes(hashes, low[used], high[used])
        keys.append(arrays.mix(context ^ (name[used] * np.uint64(2 * level + 1))))
        made += len(used)
    rest = np.flatnonzero(of < 0)
    of[rest] = made + np.arange(len(rest))
    keys.append(arrays.span_hashes(hashes, windows[rest], windows[rest] + size))
    return of, np.concatenate(keys)
