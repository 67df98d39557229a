"""Bit-sliced Hamming comparison and vertical counters.

Fingerprints are kept as bit planes: plane b holds bit b of 64 fingerprints in one 64-bit lane word. Comparing a
fingerprint with a block of 64 is then an exclusive-or per plane, and the 64 running distances are counters that
lie across words: a carry-save adder takes three planes at a time and adds their sum and carry into the counters.
A block is abandoned as soon as every lane's distance is beyond the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .textbatch import mix64

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def bit_planes(prints: np.ndarray, chunk: int = 128) -> np.ndarray:
    """(rows, words) uint64 fingerprints to (64 * words, blocks) planes; lane i of a block is its i-th row.

    ``chunk`` blocks are spread out to a byte a bit at a time.
    """
    rows, words = prints.shape
    blocks = -(-rows // 64)
    planes = np.empty((words * 64, blocks), np.uint64)
    for at in range(0, blocks, chunk):
        n = min(chunk, blocks - at)
        part = np.zeros((n * 64, words), np.uint64)
        given = prints[at * 64 : (at + n) * 64]
        part[: len(given)] = given
        bits = np.unpackbits(part.view(np.uint8).reshape(n * 64, words * 8), axis=1, bitorder="little")
        lanes = np.packbits(bits.T.reshape(words * 64, n, 64), axis=2, bitorder="little")
        planes[:, at : at + n] = np.ascontiguousarray(lanes).reshape(words * 64, n * 8).view(np.uint64)
    return planes


def lanes_within(planes: np.ndarray, block: np.ndarray, prints: np.ndarray, radius: int, check_every: int = 12) -> np.ndarray:
    """For each pair of a fingerprint (row of ``prints``) and a block: the 64-bit mask of lanes within ``radius``."""
    n, bits = len(block), planes.shape[0]
    width = max(1, (radius + 1).bit_length())
    result = np.zeros(n, np.uint64)
    live = np.arange(n)
    counters = np.zeros((width, n), np.uint64)
    over = np.zeros(n, np.uint64)

    def add(plane: np.ndarray, at: int) -> None:
        """Ripple a plane of weight 2**at into the counters; what leaves the top marks the lane as beyond."""
        for k in range(at, width):
            carry = counters[k] & plane
            counters[k] ^= plane
            plane = carry
        np.bitwise_or(over, plane, out=over)

    def beyond() -> np.ndarray:
        """Lanes whose counter is larger than the radius, or ran over."""
        more, same = np.zeros_like(over), np.full_like(over, ONES)
        for k in reversed(range(width)):
            if radius >> k & 1:
                same &= counters[k]
            else:
                more |= same & counters[k]
                same &= ~counters[k]
        return more | over

    since, word, mine, where = 0, -1, prints[:0, 0], block

    def difference(b: int) -> np.ndarray:
        bit = (mine >> np.uint64(b & 63)) & np.uint64(1)
        return planes[b, where] ^ (np.uint64(0) - bit)

    for b in range(0, bits, 3):
        group = []
        for x in range(b, min(b + 3, bits)):
            if x >> 6 != word:
                word = x >> 6
                mine = prints[live, word]
            group.append(difference(x))
        if len(group) == 3:
            x, y, z = group
            half = x ^ y
            carry = (x & y) | (half & z)
            add(half ^ z, 0)
            if width > 1:
                add(carry, 1)
            else:
                np.bitwise_or(over, carry, out=over)
        else:
            for x in group:
                add(x, 0)
        since += 3
        if since >= check_every and b + 3 < bits:
            since = 0
            keep = beyond() != ONES
            if not keep.all():
                live, counters, over, mine, where = live[keep], counters[:, keep], over[keep], mine[keep], where[keep]
                if not len(live):
                    return result
    result[live] = ~beyond()
    return result


def column_counts(words: np.ndarray) -> np.ndarray:
    """How many rows of a (rows, words) uint64 array have each bit set, by carry-save addition of whole rows.

    Three rows of one weight become a sum row of that weight and a carry row of the next, until one row is left
    for each weight.
    """
    width = words.shape[1]
    total = np.zeros(width * 64, np.int64)
    level, weight = words, 0
    while len(level):
        carries: list[np.ndarray] = []
        while len(level) > 2:
            third = len(level) // 3
            x, y, z = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            half = x ^ y
            carries.append((x & y) | (half & z))
            level = np.concatenate([half ^ z, level[3 * third :]])
        if len(level) == 2:
            carries.append((level[0] & level[1])[None])
            level = (level[0] ^ level[1])[None]
        total += np.unpackbits(np.ascontiguousarray(level[0]).view(np.uint8), bitorder="little").astype(np.int64) << weight
        level = np.concatenate(carries) if carries else level[:0]
        weight += 1
    return total


def _set_lanes(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and lane of every set bit."""
    bits = np.unpackbits(masks.view(np.uint8).reshape(len(masks), 8), axis=1, bitorder="little")
    return np.nonzero(bits)


def contract(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of linked rows in place; every label ends as the smallest row of its class."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def group_labels(prints: np.ndarray, starts: np.ndarray, radius: int, slab: int = 1 << 15) -> np.ndarray:
    """For each row the smallest row of its component within its group; groups are runs of rows that begin at ``starts``.

    All groups are compared at once: each row with the blocks of 64 of its group up to its own, ``slab`` of these pairs
    at a time.
    """
    bounds = np.append(starts, len(prints))
    size = np.diff(bounds)
    blocks = -(-size // 64)
    labels = np.arange(len(prints))
    rows_of, pairs_of = size, blocks * (2 * size - 64 * (blocks - 1)) // 2  # sum of (own block + 1) over the rows
    ends = np.cumsum(pairs_of)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + slab, side="right")))
        lo, hi = int(bounds[at]), int(bounds[to])
        group = np.repeat(np.arange(to - at), rows_of[at:to])
        place = np.arange(lo, hi) - bounds[at:to][group]
        first_block = np.concatenate([[0], np.cumsum(blocks[at:to])])
        padded = np.zeros((int(first_block[-1]) * 64, prints.shape[1]), np.uint64)
        padded[first_block[group] * 64 + place] = prints[lo:hi]
        planes = bit_planes(padded)
        own = place // 64
        n = own + 1
        pair_ends = np.cumsum(n)
        row = np.repeat(np.arange(hi - lo), n)
        step = np.arange(int(pair_ends[-1])) - np.repeat(pair_ends - n, n)
        mask = lanes_within(planes, first_block[group[row]] + step, prints[lo:hi][row], radius)
        same = step == own[row]
        earlier = (np.uint64(1) << (place[row[same]] % 64).astype(np.uint64)) - np.uint64(1)
        mask[same] &= earlier
        hit = np.flatnonzero(mask)
        for k in range(0, len(hit), slab):
            part = hit[k : k + slab]
            r, lane = _set_lanes(mask[part])
            one = row[part][r]
            contract(labels, lo + one, bounds[at:to][group[one]] + step[part][r] * 64 + lane)
        at = to
    return labels


def large_group(prints: np.ndarray, radius: int, seeds: int = 64) -> Iterator[tuple[int, int]]:
    """Links that join each component of one group, at most one per row; lossless for the components.

    Seeds are compared with all rows not yet placed. A seed without a link is done; else its component is searched
    breadth first, and rows found leave the comparison, so a dense group costs little more than its size.
    """
    active = np.arange(len(prints))
    planes = bit_planes(prints)

    def compare(rows: np.ndarray) -> np.ndarray:
        """(rows, active) booleans."""
        blocks = planes.shape[1]
        masks = lanes_within(planes, np.tile(np.arange(blocks), len(rows)), np.repeat(prints[rows], blocks, axis=0), radius)
        bits = np.unpackbits(masks.view(np.uint8).reshape(len(rows), blocks * 8), axis=1, bitorder="little")
        return bits[:, : len(active)].astype(bool)

    def narrow(gone: np.ndarray) -> None:
        nonlocal active, planes
        keep = ~gone[active]
        if not keep.all():
            active = active[keep]
            if len(active):
                planes = bit_planes(prints[active])

    gone = np.zeros(len(prints), bool)
    while len(active):
        rows, pool = active[:seeds], active
        near = compare(rows)
        for i, row in enumerate(rows.tolist()):
            if gone[row]:
                continue
            gone[row] = True
            found = pool[near[i]]
            found = found[~gone[found]]  # a finished component has no link to this row
            if not len(found):
                continue
            gone[found] = True
            yield from ((row, x) for x in found.tolist())
            frontier = found
            narrow(gone)
            while len(frontier) and len(active):
                part, frontier = frontier[:seeds], frontier[seeds:]
                linked = compare(part)
                hit = np.flatnonzero(linked.any(axis=0))
                if len(hit):
                    fresh = active[hit]
                    yield from zip(part[linked[:, hit].argmax(axis=0)].tolist(), fresh.tolist())
                    gone[fresh] = True
                    frontier = np.concatenate([frontier, fresh])
                    narrow(gone)
        narrow(gone)


def mix64_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """(n,) uint64 hashes to (n, words): the hash itself, then further words mixed from it."""
    out = np.empty((len(hashes), words), np.uint64)
    out[:, 0] = hashes
    for k in range(1, words):
        out[:, k] = mix64(hashes + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    return out
