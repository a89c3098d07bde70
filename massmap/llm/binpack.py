"""Bin completion on a histogram of sizes: how many bins are filled in which way.

The histogram has at most ``capacity`` entries however many items there are, so
the search does not grow with the corpus: a filling is applied as often as the
counts allow.
"""

from __future__ import annotations

from bisect import bisect_right

Filling = tuple[tuple[int, int], ...]  # ((size, how many), ...), largest first
Plan = list[tuple[Filling, int]]  # fillings and how many bins have them

#: Nodes of the search, and fillings compared at each; they bound effort, never what is packed.
NODES = 4000
FILLINGS = 48


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by total size, and by items that cannot share a bin."""
    total = sum(size * n for size, n in counts.items())
    best = -(-total // capacity)
    for least in {size for size in counts if 2 * size <= capacity} | {0}:
        alone = sum(n for size, n in counts.items() if size > capacity - least)
        paired = {s: n for s, n in counts.items() if capacity - least >= s and 2 * s > capacity}
        small = sum(s * n for s, n in counts.items() if least <= s and 2 * s <= capacity)
        room = sum((capacity - s) * n for s, n in paired.items())
        best = max(best, alone + sum(paired.values()) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, many equal items at a time."""
    open_: dict[int, dict[Filling, int]] = {capacity: {}}
    rooms: list[int] = []

    def put(room: int, filling: Filling, bins: int) -> None:
        if room not in open_ or not open_[room]:
            open_.setdefault(room, {})
            rooms.insert(bisect_right(rooms, room), room)
        open_[room][filling] = open_[room].get(filling, 0) + bins

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_right(rooms, size - 1)
            if at < len(rooms):
                room = rooms[at]
                filling, bins = next(iter(open_[room].items()))
                each = min(room // size, left)
                used = min(bins, left // each)
                if used == bins:
                    del open_[room][filling]
                else:
                    open_[room][filling] = bins - used
                if not open_[room]:
                    rooms.pop(at)
            else:
                room, filling = capacity, ()
                each = min(capacity // size, left)
                used = left // each
            put(room - each * size, filling + ((size, each),), used)
            left -= each * used
    return [(filling, bins) for held in open_.values() for filling, bins in held.items()]


def undominated(sizes: list[int], counts: dict[int, int], room: int, wanted: int, waste: int):
    """Fillings of ``room`` that no other filling dominates, least waste first, at most ``wanted``.

    A filling is dominated if another item still fits, or if one of its items can
    be exchanged for a larger one that is at hand. ``sizes`` ascends. Search goes
    from large to small items, so a perfect single item is found at once.
    """
    found: list[tuple[int, Filling]] = []
    steps = wanted * 40

    def dominated(parts: list[tuple[int, int]], slack: int) -> bool:
        used = dict(parts)
        smallest = next((s for s in sizes if counts[s] > used.get(s, 0)), None)
        if smallest is not None and smallest <= slack:
            return True
        for size, _ in parts:
            for larger in sizes[bisect_right(sizes, size) : bisect_right(sizes, size + slack)]:
                if counts[larger] > used.get(larger, 0):
                    return True
        return False

    def extend(top: int, room: int, parts: list[tuple[int, int]]) -> bool:
        """True when a perfect filling ends the search."""
        nonlocal steps
        at = bisect_right(sizes, min(top, room)) - 1
        if at < 0 or room == 0:
            if room <= waste and not dominated(parts, room):
                found.append((room, tuple(parts)))
            return room == 0
        for k in range(at, -1, -1):
            size = sizes[k]
            most = min(counts[size], room // size)
            for n in range(most, 0, -1):
                steps -= 1
                if steps < 0 or len(found) >= wanted:
                    return False
                parts.append((size, n))
                perfect = extend(size - 1, room - n * size, parts)
                parts.pop()
                if perfect:
                    return True
        if not parts and room <= waste:
            found.append((room, ()))
        return False

    extend(room, room, [])
    found.sort(key=lambda entry: entry[0])
    return found


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES, fillings: int = FILLINGS) -> Plan:
    """Branch and bound over fillings around the largest item left.

    The incumbent is best-fit decreasing. A branch is cut when its bins and the
    bins that the total of what is left needs at least reach the incumbent; the
    search ends when the incumbent meets the lower bound or ``nodes`` are spent.
    """
    counts = {size: n for size, n in counts.items() if n > 0}
    if not counts:
        return []
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError("an item must have a size from 1 to the capacity")
    best = best_fit(counts, capacity)
    fewest = sum(bins for _, bins in best)
    bound = lower_bound(counts, capacity)
    # each entry: what is left, bins used, the fillings so far as a linked list
    stack = [(counts, 0, None)]
    while stack and fewest > bound and nodes:
        left, used, chosen = stack.pop()
        if not left:
            if used < fewest:
                fewest, best = used, []
                while chosen:
                    chosen, filling, bins = chosen
                    best.append((filling, bins))
            continue
        total = sum(size * n for size, n in left.items())
        if used - (-total // capacity) >= fewest:
            continue
        nodes -= 1
        sizes = sorted(left)
        largest = sizes[-1]
        rest = dict(left)
        rest[largest] -= 1
        spare = (fewest - 1 - used) * capacity - total  # waste that still improves on the incumbent
        options = undominated([s for s in sizes if rest[s]], rest, capacity - largest, fillings, spare)
        branches = []
        for waste, others in options:
            filling = dict(others)
            filling[largest] = filling.get(largest, 0) + 1
            bins = min(left[size] // n for size, n in filling.items())
            if waste:
                bins = min(bins, max(1, spare // waste))
            after = {s: n - bins * filling.get(s, 0) for s, n in left.items()}
            branches.append(
                ({s: n for s, n in after.items() if n}, used + bins, (chosen, tuple(sorted(filling.items(), reverse=True)), bins))
            )
        # the least waste is followed first; of the others the few best wait for backtracking
        stack.extend(reversed(branches[:8]))
    return best
