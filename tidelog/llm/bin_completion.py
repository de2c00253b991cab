"""Packing of lengths into sequences by bin completion, on a histogram of lengths.

Pieces of one length are interchangeable, so a packing is a list of fillings (lengths with their counts in one sequence), each with
the number of sequences filled so.  Its size depends on the capacity alone, never on the number of documents.

The search fixes one sequence after the other: around the largest length left it enumerates fillings, fullest first, and skips the
dominated ones - those in which a longer piece that is left could stand for one or several pieces of the filling.  A filling is
repeated as often as the counts allow.  A branch ends where its waste leaves no room for a better packing than the best one
known; best-fit decreasing of what is left gives such a packing at every node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

Filling = tuple[tuple[int, int], ...]  # (length, count) by falling length


@dataclass
class Packing:
    fillings: list[tuple[Filling, int]]
    sequences: int
    bound: int  # no packing has fewer sequences
    nodes: int


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The larger of the total by capacity and, for every threshold, the count of pieces that cannot share a sequence plus what
    the middle-sized ones need beyond the room left beside them."""
    lengths = np.arange(capacity + 1)
    number, total = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * lengths)))
    low = np.arange(capacity // 2 + 1)  # threshold: pieces shorter than it are left out
    half, top = capacity // 2, capacity - low
    wide = number[-1] - number[top + 1]
    middle, middle_total = number[top + 1] - number[half + 1], total[top + 1] - total[half + 1]
    small_total = total[half + 1] - total[low]
    more = -((middle * capacity - middle_total - small_total) // capacity)
    return int((wide + middle + np.maximum(more, 0)).max())


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing, all pieces of one length at a time: each goes where it leaves the least room."""
    open_: dict[int, list[tuple[tuple, int]]] = {}  # room left -> (filling as nested pairs, sequences)

    def put(room: int, filling: tuple, number: int) -> None:
        open_.setdefault(room, []).append((filling, number))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        for room in sorted(r for r in open_ if r >= length):
            if not left:
                break
            groups, each = open_.pop(room), room // length
            while groups and left:
                filling, number = groups.pop()
                full = min(number, left // each)
                if full:
                    put(room - each * length, ((length, each), filling), full)
                left -= full * each
                number -= full
                if number and left:  # fewer than ``each`` are left: they share one sequence
                    put(room - left * length, ((length, left), filling), 1)
                    number, left = number - 1, 0
                if number:
                    groups.append((filling, number))
            for filling, number in groups:
                put(room, filling, number)
        each = capacity // length
        if left // each:
            put(capacity - each * length, ((length, each), ()), left // each)
        if left % each:
            put(capacity - left % each * length, ((length, left % each), ()), 1)
    out = []
    for groups in open_.values():
        for nested, number in groups:
            filling = []
            while nested:
                entry, nested = nested
                filling.append(entry)
            out.append((tuple(filling[::-1]), number))
    return out


def _widened(bits: int, width: int) -> int:
    """All numbers from ``s`` to ``s + width`` for the numbers ``s`` in the bit set."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        bits |= bits << step
        done += step
    return bits


def _dominated(filling: Filling, room: int, left: int) -> bool:
    """Whether a length in the bit set ``left`` fits into the ``room`` unused, or could stand for pieces of ``filling`` with it."""
    single, several = 1, 0  # sums of no piece or one, and of more
    for length, count in filling:
        for _ in range(count):
            several |= ((single & ~1) << length) | (several << length)
            single |= 1 << length
    longer = _widened(single << 1, room - 1) if room else 0
    return bool(left & (_widened(several, room) | longer))


def undominated(counts: np.ndarray, room: int, width: int, steps: int) -> Iterator[Filling]:
    """Fillings of ``room`` from the lengths counted, fullest first, at most ``width``; the search looks at ``steps`` places."""
    lengths = [x for x in np.flatnonzero(counts[: room + 1]).tolist() if x]
    reach = [1]  # sums of the first i lengths, as bits
    limit = (1 << (room + 1)) - 1
    for length in lengths:
        bits, copies, take = reach[-1], min(int(counts[length]), room // length), 1
        while copies:
            now = min(take, copies)
            bits |= (bits << now * length) & limit
            copies, take = copies - now, take * 2
        reach.append(bits)
    left = 0
    for length in lengths:
        left |= 1 << length
    found = 0
    for total in range(room, -1, -1):
        if not reach[-1] >> total & 1:
            continue
        # Depth first, long pieces first; a place is (lengths still allowed, sum still wanted, filling so far).
        stack = [(len(lengths), total, ())]
        while stack and steps:
            steps -= 1
            i, wanted, filling = stack.pop()
            if not wanted:
                spent = sum(1 << length for length, count in filling if counts[length] == count)
                if not _dominated(filling, room - total, left & ~spent):
                    found += 1
                    yield filling
                    if found == width:
                        return
                continue
            if not i or not reach[i] >> wanted & 1:
                continue
            # Jump to the longest piece that fits; with fewer copies of it the others have to do.
            while lengths[i - 1] > wanted:
                i -= 1
            length = lengths[i - 1]
            for count in range(0, min(int(counts[length]), wanted // length) + 1):
                rest = wanted - count * length
                if reach[i - 1] >> rest & 1:
                    stack.append((i - 1, rest, (*filling, (length, count)) if count else filling))
        if not steps:
            return


def pack_lengths(counts: np.ndarray, capacity: int, nodes: int = 400, width: int = 8, steps: int = 20_000) -> Packing:
    """A packing of ``counts[length]`` pieces of every length up to ``capacity`` (``counts[0]`` must be 0).

    ``nodes`` bounds the places that the search visits, ``width`` the fillings tried at each and ``steps`` the work to find them; the
    packing is whole under any bound, and the fewest sequences possible wherever ``sequences == bound``.
    """
    counts = np.asarray(counts, dtype=np.int64)
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    size = sum(n for _, n in best)
    visited = 0
    # A place: counts left, sequences used, fillings chosen (nested), and the fillings still to try.
    stack = [(counts, 0, (), None)]
    while stack and size > bound and visited < nodes:
        left, used, chosen, tries = stack.pop()
        if tries is None:
            visited += 1
            if used + lower_bound(left, capacity) >= size:
                continue
            rest = best_fit(left, capacity)
            if used + sum(n for _, n in rest) < size:
                size, trail = used + sum(n for _, n in rest), chosen
                best = list(rest)
                while trail:
                    entry, trail = trail
                    best.append(entry)
            present = np.flatnonzero(left)
            if not len(present):
                continue
            largest = int(present[-1])
            beside = left.copy()
            beside[largest] -= 1
            tries = _branches(beside, left, largest, capacity, width, steps)
        for filling, times in tries:
            after = left.copy()
            for length, count in filling:
                after[length] -= count * times
            # Waste so far decides whether a better packing is still possible.
            if used + times + -(-int((after * np.arange(capacity + 1)).sum()) // capacity) >= size:
                continue
            stack.append((left, used, chosen, tries))
            stack.append((after, used + times, ((filling, times), chosen), None))
            break
    return Packing(best, size, bound, visited)


def _branches(beside: np.ndarray, left: np.ndarray, largest: int, capacity: int, width: int, steps: int) -> Iterator[tuple[Filling, int]]:
    """Fillings around ``largest``: as often as the counts allow first, a single one after it."""
    for other in undominated(beside, capacity - largest, width, steps):
        joined = dict(other)
        joined[largest] = joined.get(largest, 0) + 1
        filling = tuple(sorted(joined.items(), reverse=True))
        most = min(int(left[length]) // count for length, count in filling)
        yield filling, most
        if most > 1:
            yield filling, 1
