"""Suffix arrays of byte rows: prefix doubling, common prefixes, and merging of sorted lists."""

from __future__ import annotations

import numpy as np

#: Bits that a rank, a second rank and a place may take together to be sorted as one number.
PACKED = 63


def sorted_with(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, keys) of the rows sorted by (high, low, place); as packed numbers, which sort much faster than indices, where they fit."""
    n = len(high)
    bits, low_bits = max(1, int(n - 1).bit_length()), max(1, int(low.max(initial=0)).bit_length())
    keys = (high << low_bits) | low
    if int(high.max(initial=0)).bit_length() + low_bits + bits <= PACKED:
        packed = np.sort((keys << bits) | np.arange(n))
        return packed & ((1 << bits) - 1), packed >> bits
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


def run_starts(keys: np.ndarray) -> np.ndarray:
    """For each place in sorted keys where its run of equal keys begins."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def suffix_array(rows: np.ndarray, first: np.ndarray, last: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Larsson and Sadakane's refinement for ``rows`` (n, width) of bytes: (places in sorted order, rank of each place or -1) of the suffixes that begin in row r at ``first[r]`` to ``last[r]`` and end at ``ends[r]``.

    Places are flat indices. Groups start as what agrees in four bytes; each round sorts the
    members of each group that isn't single yet by the groups of the suffixes as many bytes
    further on, which doubles the bytes that a group agrees in. Single groups are left alone, and
    so are suffixes that no later round asks for. Equal suffixes are in order of place.
    """
    n, width = rows.shape
    column = np.arange(width)
    wanted = [(column >= first[:, None]) & (column <= last[:, None])]
    reaches = [4]
    while reaches[-1] * 2 < width:
        reaches.append(reaches[-1] * 2)
    for reach in reversed(reaches):  # who is asked for at which depth, from the last round to the first
        further = wanted[0].copy()
        further[:, reach:] |= wanted[0][:, :-reach] if reach < width else False
        wanted.insert(0, further & (column < ends[:, None]))
    flat = np.flatnonzero(wanted[0])
    padded = np.zeros((n, width + 4), np.int64)
    padded[:, :width] = np.where(column < ends[:, None], rows.astype(np.int16) + np.int16(1), 0)
    word = padded[:, :width] * 257**3 + padded[:, 1 : width + 1] * 257**2 + padded[:, 2 : width + 2] * 257 + padded[:, 3 : width + 3]
    order, keys = sorted_with(word.ravel()[flat], np.zeros(len(flat), np.int64))
    ranks = np.zeros(n * width + 1, np.int64)  # the last place stands for all ends, before everything
    starts = run_starts(keys)
    left = flat[order]
    ranks[left] = starts + 1
    left = left[np.repeat(*_sizes(starts))]
    for reach, mask in zip(reaches, wanted[1:], strict=True):
        left = left[mask.ravel()[left]]
        further, row = left + reach, left // width
        second = ranks[np.where(further < row * width + ends[row], further, n * width)]
        held = ranks[left]
        at, keys = sorted_with(held, second)
        left, held = left[at], held[at]
        group, part = run_starts(held), run_starts(keys)
        ranks[left] = held + part - group
        left = left[np.repeat(*_sizes(part))]
    flat = np.flatnonzero(wanted[-1])
    ordered = flat[sorted_with(ranks[flat], np.zeros(len(flat), np.int64))[0]]
    place = np.full(n * width, -1, np.int64)
    place[ordered] = np.arange(len(ordered))
    return ordered, place


def _sizes(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run, by where it starts for each place, whether it has several places, and how many."""
    size = np.diff(np.append(np.flatnonzero(starts == np.arange(len(starts))), len(starts)))
    return size > 1, size


def common_prefixes(rows: np.ndarray, first: np.ndarray, last: np.ndarray, ends: np.ndarray, ordered: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefixes: for each place in sorted order how many bytes, up to ``most``, its suffix shares with the one before it.

    If the suffix before it goes on to one that is sorted as well, the suffix one byte further
    on shares at least one byte less with the one before that. So bytes are compared from there
    on, along each row; all rows are walked at once, column by column.
    """
    n, width = rows.shape
    text, out = np.ascontiguousarray(rows).ravel(), np.zeros(len(ordered), np.int64)
    row_end = np.arange(n) * width + ends
    shared = np.zeros(n, np.int64)
    for column in range(int(first.min(initial=0)), int(last.max(initial=-1)) + 1):
        live = np.flatnonzero((first <= column) & (column <= last))
        at = live * width + column
        rank = place[at]
        shared[live[rank == 0]] = 0
        live, at, rank = live[rank > 0], at[rank > 0], rank[rank > 0]
        other = ordered[rank - 1]
        limit = np.minimum(np.minimum(row_end[live] - at, row_end[other // width] - other), most)
        h = np.minimum(shared[live], limit)
        open_ = np.flatnonzero(h < limit)
        while len(open_):
            open_ = open_[text[at[open_] + h[open_]] == text[other[open_] + h[open_]]]
            h[open_] += 1
            open_ = open_[h[open_] < limit[open_]]
        out[rank] = h
        goes_on = (other + 1) % width != 0
        goes_on[goes_on] = place[other[goes_on] + 1] >= 0
        shared[live] = np.where(goes_on, np.maximum(h - 1, 0), 0)
    return out


def merged(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of different byte strings, each with a number, as one: equal strings once, with their least number. Two lists at a time, the places of one found in the other by binary search."""
    while len(lists) > 1:
        lists = [_two(*lists[i : i + 2]) if i + 1 < len(lists) else lists[i] for i in range(0, len(lists), 2)]
    return lists[0]


def _two(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    (x, n), (y, m) = a, b
    at = np.searchsorted(x, y)
    met = np.zeros(len(y), bool)
    inside = at < len(x)
    met[inside] = x[at[inside]] == y[inside]
    n = n.copy()
    n[at[met]] = np.minimum(n[at[met]], m[met])
    return np.insert(x, at[~met], y[~met]), np.insert(n, at[~met], m[~met])
