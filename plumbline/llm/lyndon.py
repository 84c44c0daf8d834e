"""Suffix arrays by linear grouping: Lyndon-prefix groups, then each group's order.

Phase one keeps suffixes in groups, each an interval of the final order, and takes the groups from the
last to the first. For the suffixes of a group it finds the pointers to the previous smaller suffix,
and moves the suffixes pointed at, by how often, to groups of their own behind their old one; in the
end a group holds the suffixes with one Lyndon prefix. Phase two walks the order from the front and
places, for each suffix, the one before it and what its pointers reach, at the front of their groups.
No names are given anew and nothing recurs. (Baier, Linear-time suffix sorting, CPM 2016.)

Many short texts are sorted at once: each step takes one group of every text, so the work is done by
array operations over all texts.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then the same for the next."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


def suffix_arrays(chars: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffix arrays of texts that lie one after another in chars: places base[i]:base[i] + size[i]
    hold text i's suffixes in order, as places in chars. Each text ends with its only 0."""
    n = len(chars)
    if not n:
        return np.empty(0, np.int64)
    text = np.repeat(np.arange(len(base)), size)
    key = text * 512 + chars
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    width = np.diff(np.append(first, n))
    rank = np.empty(n + 1, np.int64)  # a suffix's group: where its interval begins; at -1, below all
    rank[order], rank[n] = np.repeat(first, width), -1
    held, begins, at, listed = (np.zeros(n, np.int64) for _ in range(4))
    held[first], begins[first + width - 1], at[first], listed[first] = width, first, first, width
    arena = np.empty(2 * n + 1, np.int64)  # members of groups as they arise; some have moved on
    arena[:n], used = order, n
    prev = np.full(n, -1, np.int64)
    lowest = np.repeat(base, size)
    top, bottom = base + size - 1, base.copy()
    while len(top):
        group = begins[top]
        members = arena[_ranges(at[group], listed[group])]
        of = np.repeat(group, listed[group])
        stay = rank[members] == of
        members, of = members[stay], of[stay]
        # Pointers to the previous smaller suffix, along pointers already known.
        to = np.where(members > lowest[members], members - 1, -1)
        prev[members] = to
        while True:
            on = rank[to] >= of
            if not on.any():
                break
            to[on] = prev[to[on]]
            prev[members] = to
        hit = np.sort(to[to >= 0])
        if len(hit):
            new = np.concatenate(([True], hit[1:] != hit[:-1]))
            where = np.flatnonzero(new)
            times = np.diff(np.append(where, len(hit)))
            hit = hit[where]
            old = rank[hit]
            by = np.lexsort((times, old))
            hit, old, times = hit[by], old[by], times[by]
            part = np.flatnonzero(np.concatenate(([True], (old[1:] != old[:-1]) | (times[1:] != times[:-1]))))
            count = np.diff(np.append(part, len(hit)))
            source = old[part]
            lead = np.flatnonzero(np.concatenate(([True], source[1:] != source[:-1])))
            moved = np.add.reduceat(count, lead)
            left = held[source[lead]] - moved
            before = np.cumsum(count) - count
            spread = np.diff(np.append(lead, len(source)))
            start = source + np.repeat(left - before[lead], spread) + before
            held[source[lead]] = left
            some = left > 0
            begins[source[lead][some] + left[some] - 1] = source[lead][some]
            rank[hit] = np.repeat(start, count)
            held[start], begins[start + count - 1] = count, start
            at[start], listed[start] = used + part, count
            arena[used : used + len(hit)] = hit
            used += len(hit)
        top = group - 1
        on = top >= bottom
        if not on.all():
            top, bottom = top[on], bottom[on]

    out = np.full(n, -1, np.int64)
    placed = np.zeros(n + 1, bool)
    placed[n] = True
    front = np.arange(n)
    end = base + size
    out[base], placed[end - 1] = end - 1, True
    i, stop = base.copy(), end
    s = np.where(size > 1, end - 2, -1)
    while len(i):
        free = ~placed[s]
        put = s[free]
        if len(put):
            g = rank[put]
            f = front[g]
            out[f] = put
            front[g] = f + 1
            placed[put] = True
            s[free] = prev[put]
        on = ~free
        if on.any():
            i[on] += 1
            live = i < stop
            if not live.all():
                i, stop, s, on = i[live], stop[live], s[live], on[live]
            k = out[i[on]]
            s[on] = np.where(k > lowest[k], k - 1, -1)
    return out
