"""Suffix arrays of many texts at once, by linear grouping of Lyndon prefixes.

Two passes, no recursion and no renaming. The first keeps suffixes in groups whose
members share a Lyndon prefix. Groups are taken in descending order; each member finds
its previous smaller suffix (the nearest one before it in a lower group), and the
suffixes so pointed at leave their group for new ones just above it: those that are
pointed at more often go higher. The second pass runs through the array in ascending
order; the suffix before each entry, and its chain of previous smaller suffixes, take
the next free place of their group.

Each text advances by one group (or one entry) a step, and a step handles all texts in
one go of array operations, so the cost of a step is shared by all of them. All numbers
are places in the texts laid out one after the other; no number crosses a text's bounds.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Start positions in ascending order of suffix, text by text; text i is text[bounds[i] : bounds[i + 1]].

    The last symbol of each text must be smaller than all its others. Symbols aren't negative.
    """
    bounds = np.asarray(bounds, np.int64)
    bounds = bounds[np.concatenate([[True], np.diff(bounds) > 0])]
    if len(bounds) < 2:
        return np.zeros(0, np.int64)
    group, smaller = grouped(text, bounds)
    return emitted(group, smaller, bounds)


def grouped(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each suffix's group, and its previous smaller suffix (-1: none)."""
    n, begin, end = len(text), bounds[:-1], bounds[1:].copy()
    lane = np.repeat(np.arange(len(begin)), np.diff(bounds))
    key = lane * (int(text.max()) + 1) + text
    place = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[place], prepend=-1))
    sizes = np.diff(np.append(first, n))
    at, group, size = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    at[place] = np.arange(n)
    group[place] = np.repeat(first, sizes)
    size[first] = sizes
    smaller, chosen = np.full(n, -1, np.int64), np.zeros(n, bool)
    leads = np.zeros(n, bool)
    leads[begin] = True
    live = np.arange(len(begin))
    while len(live):
        stop = end[live]
        start = group[place[stop - 1]]
        count = stop - start
        total = int(count.sum())
        if total == len(live):
            s, least = place[start], start
        else:
            least = np.repeat(start, count)
            s = place[least + np.arange(total) - np.repeat(np.cumsum(count) - count, count)]
        j = np.where(leads[s], -1, s - 1)
        smaller[s] = j
        # members of the same group are passed by way of how far they have come
        todo = np.flatnonzero(j >= 0)
        while len(todo):
            todo = todo[group[j[todo]] >= least[todo]]
            further = smaller[j[todo]]
            j[todo] = further
            smaller[s[todo]] = further
            todo = todo[further >= 0]
        raise_pointed(np.sort(j[j >= 0]), place, at, group, size, chosen)
        end[live] = start
        live = live[start > begin[live]]
    return group, smaller


def raise_pointed(pointed: np.ndarray, place: np.ndarray, at: np.ndarray, group: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> None:
    """Move the suffixes pointed at (sorted, with repeats) to the end of their groups, in new groups by how often."""
    if not len(pointed):
        return
    first = np.flatnonzero(np.diff(pointed, prepend=-1))
    times = np.diff(np.append(first, len(pointed)))
    j = pointed[first]
    g = group[j]
    order = np.lexsort((times, g))
    j, times, g = j[order], times[order], g[order]
    new = np.diff(g, prepend=-1) != 0
    lead = np.flatnonzero(new)
    chosen_of = np.diff(np.append(lead, len(j)))
    left = size[g[lead]] - chosen_of
    border = np.repeat(g[lead] + left, chosen_of)
    slot = border + np.arange(len(j)) - np.repeat(lead, chosen_of)
    # what stands in the last places and isn't pointed at takes the places that fall free
    here = at[j]
    chosen[j] = True
    there = place[slot]
    moved = there[~chosen[there]]
    chosen[j] = False
    free = here[here < border]
    place[free] = moved
    at[moved] = free
    place[slot] = j
    at[j] = slot
    new[1:] |= times[1:] != times[:-1]
    run = np.flatnonzero(new)
    length = np.diff(np.append(run, len(j)))
    size[g[lead]] = left  # a group that leaves nothing behind is its own lowest run
    size[slot[run]] = length
    group[j] = np.repeat(slot[run], length)


def emitted(group: np.ndarray, smaller: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix arrays of the groups."""
    n = len(group)
    out, free = np.zeros(n, np.int64), np.arange(n)
    done = np.zeros(n + 1, bool)
    done[-1] = True  # no suffix (-1)
    lead, at, end = bounds[:-1], bounds[:-1].copy(), bounds[1:]
    out[lead] = end - 1
    done[end - 1] = True
    j = np.where(end - 1 == lead, -1, end - 2)
    while len(at):
        spent = np.flatnonzero(done[j])
        if len(spent):
            at[spent] += 1
            over = at[spent] == end[spent]
            if over.any():
                keep = np.ones(len(at), bool)
                keep[spent[over]] = False
                at, end, lead, j = at[keep], end[keep], lead[keep], j[keep]
                spent = (np.cumsum(keep) - 1)[spent[~over]]
            s = out[at[spent]]
            j[spent] = np.where(s == lead[spent], -1, s - 1)
        ready = np.flatnonzero(~done[j])
        s = j[ready]
        done[s] = True
        g = group[s]
        place = free[g]
        out[place] = s
        free[g] = place + 1
        j[ready] = smaller[s]
    return out
