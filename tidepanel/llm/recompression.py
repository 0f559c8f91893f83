"""Recompression of token sequences: equal substrings get equal symbols but for a few at their ends.

Rounds replace runs of one symbol and pairs of a left and a right symbol by new ones. A name is a
hash of what it stands for, so all tasks of a Spark round agree on it without a dictionary. A round
touches only symbols of at most its length, so a symbol can be changed by what lies outside a window
only if it is short and at the window's end: such symbols are taken off the window round by round,
and what remains, its interior, depends on the window's tokens alone.
"""

from __future__ import annotations

import numpy as np

#: Tokens of a window.
WINDOW = 50
#: Rounds: what is replaced, and the longest symbol (in tokens) that takes part. Their lengths sum to less than
#: half a window, so that a window keeps an interior unless runs reach into it.
ROUNDS = (("run", 1), ("pair", 1), ("pair", 1), ("pair", 1), ("run", 2), ("pair", 2), ("pair", 2), ("pair", 2),
          ("run", 4), ("pair", 4), ("pair", 4))
assert 2 * sum(most for _, most in ROUNDS) < WINDOW
#: The key of a window without an interior; no symbol has it, as lengths are at least 1.
NO_SYMBOL = np.uint64((1 << 64) - 1)

_A, _B, _C = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def windows(owner: np.ndarray) -> np.ndarray:
    """First places of the windows, none of which spans two owners; ``owner`` ascends."""
    if len(owner) < WINDOW:
        return np.zeros(0, np.int64)
    return np.flatnonzero(owner[:len(owner) - WINDOW + 1] == owner[WINDOW - 1:])


def window_names(tokens: np.ndarray) -> np.ndarray:
    """A hash of the window from each place on, made of hashes of powers of two of tokens."""
    parts, power, left = [], 1, WINDOW
    level = tokens
    while left:
        if left & 1:
            parts.append((power, level))
        left >>= 1
        if left:
            level = mixed(level[:-power] * _B + level[power:] * _C) if len(level) > power else level[:0]
            power *= 2
    n, at = max(0, len(tokens) - WINDOW + 1), 0
    out = np.zeros(n, np.uint64)
    for size, names in parts:
        out = mixed(out * _C + names[at:at + n] * _B)
        at += size
    return out


def recompress(tokens: np.ndarray, owner: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the last round's symbols, and each window's interior as a range of them (empty: 0, 0).

    A key holds a symbol's length and its name; the smaller, the longer.
    """
    name, of = tokens, owner
    size = np.ones(len(tokens), np.int64)
    left, right = first.copy(), first + WINDOW
    for turn, (kind, most) in enumerate(ROUNDS):
        short = size <= most
        # a symbol goes into its predecessor's group
        follows = np.zeros(len(name), bool)
        if kind == "run":
            follows[1:] = (name[1:] == name[:-1]) & short[1:] & short[:-1] & (of[1:] == of[:-1])
        else:
            side = mixed(name ^ np.uint64(0x1234567 * (turn + 1))) >> np.uint64(63)
            is_right = side == 1
            follows[1:] = is_right[1:] & ~is_right[:-1] & short[1:] & short[:-1] & (of[1:] == of[:-1])
        head = np.flatnonzero(~follows)
        group = np.cumsum(~follows) - 1
        w = np.flatnonzero(left < right)
        low, high = left[w], right[w] - 1
        if kind == "run":
            new_left = group[low] + short[low]
            new_right = group[high] + ~short[high]
            times = np.diff(np.append(head, len(name)))
            merged, made = times > 1, mixed(mixed(name[head] + np.uint64(turn + 1)) + times.astype(np.uint64))
        else:
            low += short[low] & is_right[low]
            high -= short[high] & ~is_right[high]
            inside = low <= high
            new_left, new_right = np.zeros((2, len(w)), np.int64)
            new_left[inside], new_right[inside] = group[low[inside]], group[high[inside]] + 1
            after = np.minimum(head + 1, len(name) - 1)
            merged = np.diff(np.append(head, len(name))) > 1
            made = mixed(mixed(name[head] * _B + np.uint64(turn + 1)) + name[after] * _C)
        empty = new_left >= new_right
        new_left[empty] = new_right[empty] = 0
        left[w], right[w] = new_left, new_right
        name = np.where(merged, made, name[head])
        size = np.add.reduceat(size, head) if len(head) else size
        of = of[head]
    key = (63 - np.minimum(size, 62)).astype(np.uint64) << np.uint64(58) | mixed(name) >> np.uint64(6)
    return key, left, right


def anchors(key: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest key (the longest symbol) in each window's interior; NO_SYMBOL for an empty one."""
    out = np.full(len(left), NO_SYMBOL)
    held = np.flatnonzero(left < right)
    span = right[held] - left[held]
    least, power = key, 1
    while len(held):
        now = (span >= power) & (span < 2 * power)
        w = held[now]
        out[w] = np.minimum(least[left[w]], least[right[w] - power])
        held, span = held[~now], span[~now]
        if len(least) > power:
            least = np.minimum(least[:-power], least[power:])
        power *= 2
    return out

