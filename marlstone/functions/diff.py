"""Differences of two lists of lines, in time near to their length.

Common ends go first. Lines that stand once in both sides are anchors where they keep their order (patience: the longest
increasing run of their places); what lies between two anchors is compared in turn. A part without anchors is compared by
Myers' greedy search, as long as few lines differ; beyond that its lines count as their n-th occurrence, which makes them
unique, and anchor it. So no part takes more than its length by its differences, of which MOST_EDITS count at most.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

MOST_EDITS = 64

Match = tuple[int, int]
Change = tuple[str, int, int, int, int]


def _increasing(pairs: list[Match]) -> list[Match]:
    """Of pairs in the order of their first places, the longest run whose second places grow, too."""
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        back[k] = at[n - 1] if n else -1
        ends[n : n + 1], at[n : n + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _unique(a: list, b: list) -> list[Match]:
    """Anchors: places of what stands once in both lists."""
    n, m = Counter(a), Counter(b)
    where = {x: j for j, x in enumerate(b) if m[x] == 1}
    return _increasing([(i, where[x]) for i, x in enumerate(a) if n[x] == 1 and x in where])


def _numbered(lines: list) -> list[tuple]:
    seen: Counter = Counter()
    out = []
    for x in lines:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def _myers(a: list, b: list) -> list[Match] | None:
    """Matches of a shortest script, or None if it has more than MOST_EDITS edits."""
    n, m = len(a), len(b)
    reach, trace = {1: 0}, []
    for d in range(min(n + m, MOST_EDITS) + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1) else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                return _walked(trace, n, m)
    return None


def _walked(trace: list[dict[int, int]], x: int, y: int) -> list[Match]:
    out = []
    for d in range(len(trace) - 1, -1, -1):
        reach, k = trace[d], x - y
        up = k == -d or k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)
        k = k + 1 if up else k - 1
        before = reach[k] if d else 0
        start = (before, before - k) if d else (0, 0)
        # The diagonal behind the step, from its end.
        while x > (start[0] + (0 if up else 1) if d else 0) and y > (start[1] + (1 if up else 0) if d else 0):
            x, y = x - 1, y - 1
            out.append((x, y))
        x, y = start
    return out[::-1]


def matches(a: list, b: list) -> list[Match]:
    """Pairs of equal lines (i, j), both growing."""
    out: list[Match] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        left, right = a[i:n], b[j:m]
        found = _unique(left, right)
        if not found:
            if (whole := _myers(left, right)) is not None:
                out += [(i + x, j + y) for x, y in whole]
                continue
            found = _unique(_numbered(left), _numbered(right))
        if not found:
            continue
        out += [(i + x, j + y) for x, y in found]
        edges = [(-1, -1), *found, (len(left), len(right))]
        todo += [(i + p + 1, i + x, j + q + 1, j + y) for (p, q), (x, y) in zip(edges, edges[1:]) if x > p + 1 and y > q + 1]
    return sorted(out)


def changes(a: list, b: list) -> list[Change]:
    """What turns a into b, in order: replace, delete or insert, with the places in a and in b."""
    out, i, j = [], 0, 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        if x > i or y > j:
            out.append(("replace" if x > i and y > j else "delete" if x > i else "insert", i, x, j, y))
        i, j = x + 1, y + 1
    return out


def replayed(a: list, b: list, found: list[Change]) -> list:
    """b again, from a and the changes."""
    out, at = [], 0
    for _, i1, i2, j1, j2 in found:
        out += a[at:i1] + b[j1:j2]
        at = i2
    return out + a[at:]
