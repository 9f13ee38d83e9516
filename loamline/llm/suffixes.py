"""Deep-shallow sorting of byte strings, and what sorted contexts say about shared windows.

Strings are split by three-way radix quicksort on single bytes down to a shallow depth. Groups that still
agree there have long common prefixes; a blind trie orders those: it keeps only the depth and byte of each
branching, so an insertion descends without comparing, reads the text once to find where it differs,
and splits the path there.
"""

from __future__ import annotations

import numpy as np

#: Bytes beyond the known common prefix that quicksort looks at before blind tries take over.
SHALLOW = 8


def common_prefix(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the longest common prefix, which is known to be at least low."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Branch:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int):
        self.depth, self.kids = depth, {}


def _at(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_trie(strings: list[bytes], group: list[int], known: int) -> tuple[list[int], list[int]]:
    """The group in order, and the common prefix of each member with the one before (the first: known)."""
    root: _Branch | list = [group[0]]
    for k in group[1:]:
        s, node = strings[k], root
        while isinstance(node, _Branch):  # blind: any leaf that the kept bytes lead to
            node = node.kids.get(_at(s, node.depth)) or next(iter(node.kids.values()))
        other = strings[node[0]]
        depth = common_prefix(s, other, min(known, len(s), len(other)))
        if depth == len(s) == len(other):
            node.append(k)
            continue
        above, node = None, root
        while isinstance(node, _Branch) and node.depth < depth:
            above, node = node, node.kids[_at(s, node.depth)]
        if isinstance(node, _Branch) and node.depth == depth:
            node.kids[_at(s, depth)] = [k]
            continue
        branch = _Branch(depth)
        branch.kids = {_at(other, depth): node, _at(s, depth): [k]}
        if above is None:
            root = branch
        else:
            above.kids[_at(s, above.depth)] = branch
    order, lcp = [], []
    stack: list[tuple[_Branch | list, int]] = [(root, known)]
    while stack:
        node, before = stack.pop()
        if isinstance(node, _Branch):
            kids = sorted(node.kids)
            stack += [(node.kids[c], node.depth if c != kids[0] else before) for c in reversed(kids)]
        else:
            order += node
            lcp += [before] + [len(strings[node[0]])] * (len(node) - 1)
    return order, lcp


def deep_shallow_sort(strings: list[bytes], known: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Positions in order, and each one's common prefix with the one before it (0 for the first)."""
    order: list[int] = []
    lcp: list[int] = []
    stack = [(list(range(len(strings))), min([known, *map(len, strings)]), 0)]
    floor = stack[0][1]
    while stack:
        group, depth, before = stack.pop()
        if len(group) == 1:
            order += group
            lcp.append(before)
        elif depth >= floor + shallow:
            got, more = blind_trie(strings, group, depth)
            order += got
            lcp += [before, *more[1:]]
        else:
            pivot = _at(strings[group[len(group) // 2]], depth)
            parts: tuple[list[int], list[int], list[int]] = ([], [], [])
            for k in group:
                c = _at(strings[k], depth)
                parts[(c > pivot) + (c >= pivot)].append(k)
            less, same, more = parts
            todo = []
            for part, down in ((less, depth), (same, depth + 1), (more, depth)):
                if part:
                    todo.append((part, down, before if not todo else depth))
            if pivot == -1:  # equal strings that end here
                todo = [x for x in todo if x[0] is not same]
                order += same
                lcp += [before] + [depth] * (len(same) - 1)
                todo = [(part, down, depth) for part, down, _ in todo]
            stack += reversed(todo)
    return order, lcp


def _outward(lcp: np.ndarray, k: int, m: int) -> np.ndarray:
    """Common prefixes of the k-th sorted string with every sorted string, by minima of neighbours' ones."""
    out = np.full(m, 1 << 30)
    if k + 1 < m:
        out[k + 1 :] = np.minimum.accumulate(lcp[k + 1 :])
    if k:
        out[:k] = np.minimum.accumulate(lcp[k:0:-1])[::-1]
    return out


def shared_windows(left: list[bytes], right: list[bytes], length: int, known: int) -> list[list[tuple[int, int]]]:
    """For strings left[k] (reversed, ending before an anchor) and right[k] (from the anchor on): the ranges [a, b] of
    distances s such that the window from s bytes before the anchor, length bytes long, is one that another string has, too."""
    m = len(left)
    if m == 2:
        back, on = common_prefix(left[0], left[1]), min(length, common_prefix(right[0], right[1]))
        spans = [(length - on, back)] if length - on <= back else []
        return [spans, spans]
    order, lcp = deep_shallow_sort(right, known)
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    lcp = np.array(lcp, np.int64)
    order2, lcp2 = deep_shallow_sort(left, 0)
    rank2 = np.empty(m, np.int64)
    rank2[order2] = np.arange(m)
    lcp2 = np.array(lcp2, np.int64)
    out = []
    for k in range(m):
        on = np.minimum(_outward(lcp, int(rank[k]), m)[rank], length)
        back = _outward(lcp2, int(rank2[k]), m)[rank2]
        on[k] = 0
        back[k] = 0
        fits = on + back >= length
        if not fits.any():
            out.append([])
            continue
        low, high = length - on[fits], back[fits]
        turns = np.lexsort((-high, low))
        spans: list[tuple[int, int]] = []
        for a, b in dict.fromkeys(zip(low[turns].tolist(), high[turns].tolist(), strict=True)):
            if spans and a <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        out.append(spans)
    return out
