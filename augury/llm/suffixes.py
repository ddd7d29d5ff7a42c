"""Two-stage suffix sorting of text windows in one block of memory, and groups of equal windows."""

from __future__ import annotations

import numpy as np

PAD = 104  # zero bytes after every entry: room for the 13 eight-byte words of a suffix


def words_at(text: np.ndarray, at: np.ndarray, count: int = 13) -> np.ndarray:
    """Big-endian 8-byte words of the suffixes at ``at``: one row each."""
    raw = np.lib.stride_tricks.sliding_window_view(text, 8 * count)[at]
    return np.ascontiguousarray(raw).view(">u8").astype(np.uint64)


def suffix_order(text: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Starts of all windows in the order of their first 100 bytes.

    ``text`` holds entries, each followed by PAD zeros; entry i begins at ``begin[i]`` and has ``windows[i]`` window
    starts. Suffixes that are smaller than their successor are sorted directly. The others are induced: buckets (by
    first byte) are scanned in ascending order, and each suffix found puts its larger predecessor at the end of the
    front part of the predecessor's bucket.
    """
    n = len(text)
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    following = change[np.searchsorted(change, np.arange(n))] + 1
    smaller = np.ones(n, bool)
    inner = following < n
    smaller[inner] = text[np.flatnonzero(inner)] < text[following[inner]]
    direct_all = np.flatnonzero(smaller)
    # an entry's last windows need the chain of successors down to the next directly sorted suffix
    last = direct_all[np.searchsorted(direct_all, begin + windows - 1)]
    held = np.zeros(n + 1, np.int64)
    np.add.at(held, begin, 1)
    np.add.at(held, last + 1, -1)
    held = np.cumsum(held[:n]) > 0
    direct = direct_all[held[direct_all]]
    direct = direct[np.lexsort(words_at(text, np.minimum(direct, n - PAD)).T[::-1])]
    by_byte = np.searchsorted(text[direct], np.arange(257))
    front: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []

    def induce(found: np.ndarray, bucket: int) -> np.ndarray:
        """Deal the larger predecessors to their buckets; those of this same bucket come back as the next wave."""
        before = found[found > 0] - 1
        before = before[held[before] & ~smaller[before]]
        first = text[before]
        same = before[first == bucket]
        others, first = before[first != bucket], first[first != bucket]
        if len(others):
            by = np.argsort(first, kind="stable")
            ends = np.flatnonzero(np.append(first[by][1:] != first[by][:-1], True)) + 1
            for part in np.split(others[by], ends[:-1]):
                front[text[part[0]]].append(part)
        return same

    for bucket in range(256):
        wave = np.concatenate(front[bucket]) if front[bucket] else np.zeros(0, np.int64)
        while len(wave):
            order.append(wave)
            wave = induce(wave, bucket)
        back = direct[by_byte[bucket]: by_byte[bucket + 1]]
        if len(back):
            order.append(back)
            induce(back, bucket)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    is_window = np.zeros(n + 1, np.int64)
    np.add.at(is_window, begin, 1)
    np.add.at(is_window, begin + windows, -1)
    return order[(np.cumsum(is_window[:n]) > 0)[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = 100) -> np.ndarray:
    """Length, ``most`` at the most, of the common prefix of every suffix with the one before it in order."""
    if not len(order):
        return np.zeros(0, np.int64)
    words = words_at(text, order)
    differ = words[1:] ^ words[:-1]
    word = (differ != 0).argmax(axis=1)
    value = differ[np.arange(len(differ)), word]
    high = np.full(len(value), 8, np.int64)
    for byte in range(7, -1, -1):
        high[(value >> np.uint64(56 - 8 * byte)) & np.uint64(255) != 0] = byte
    length = np.where(value == 0, 8 * words.shape[1], 8 * word + high)
    return np.concatenate([[0], np.minimum(length, most)])


def repeated_windows(entries: list[bytes], windows: np.ndarray, place: np.ndarray, size: int = 100) -> list[np.ndarray]:
    """For every entry, which of its windows of ``size`` bytes also starts at an earlier place.

    ``place`` is the rank of each entry's first window in the order of the documents; windows of an entry follow one
    another, and places are far enough apart that ``place + i`` orders all windows.
    """
    lengths = np.array([len(e) for e in entries], np.int64)
    begin = np.cumsum(lengths + PAD) - lengths - PAD
    text = np.frombuffer(b"".join([e + bytes(PAD) for e in entries]), np.uint8)
    order = suffix_order(text, begin, windows)
    group = np.cumsum(common_prefixes(text, order, size) < size)
    entry = np.searchsorted(begin, order, "right") - 1
    inside = order - begin[entry]
    by = np.lexsort((inside, place[entry], group))
    first = np.ones(len(by), bool)
    first[1:] = group[by][1:] != group[by][:-1]
    again = by[~first]
    out = [np.zeros(n, bool) for n in windows]
    flat = np.zeros(int(windows.sum()), bool)
    base = np.cumsum(windows) - windows
    flat[base[entry[again]] + inside[again]] = True
    return np.split(flat, np.cumsum(windows)[:-1]) if len(out) else []
