"""Trees of sets: their nodes hold OR-combined token bitmaps and ranges of sizes."""

from __future__ import annotations

import numpy as np

#: Children of a node; bits of a bitmap are this many times the largest set, within the bounds.
FAN, SPARSE, LEAST_BITS, MOST_BITS = 4, 8, 256, 1 << 14
#: Node pairs looked at together.
PAIRS = 200_000
#: Sets, and pairs of a set and a root, looked at together where bitmaps have MOST_BITS.
ADMITTED_SETS, ADMITTED_PAIRS = 256, 10_000


def signatures(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, ...]:
    """A leaf for each set: the bitmap's words, its size twice (least and most below the node), its excess."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    bitmaps = np.zeros((len(sets), bits), bool)
    for row, s in enumerate(sets):
        bitmaps[row, (s & np.uint64(bits - 1)).astype(np.int64)] = True
    # Tokens beyond one a bit; so many more may two sets share than their bitmaps do.
    excess = sizes - bitmaps.sum(1)
    return np.packbits(bitmaps, axis=1).view(np.uint64), sizes, sizes, excess


def root_of(leaves: tuple[np.ndarray, ...]) -> tuple[bytes, int, int, int]:
    """One node above all leaves: bitmap, least and most size, excess."""
    words, least, most, excess = leaves
    return np.bitwise_or.reduce(words, axis=0).tobytes(), int(least.min()), int(most.max()), int(excess.max())


def admitted(sets: tuple[np.ndarray, ...], roots: tuple[np.ndarray, ...], percent: int):
    """Pairs of a set and a root that may have a link below it, in blocks."""
    for start in range(0, len(sets[0]), ADMITTED_SETS):
        end = min(start + ADMITTED_SETS, len(sets[0]))
        sizes = sets[1][start:end, None]
        i, j = np.nonzero((100 * sizes >= percent * roots[1][None]) & (100 * roots[2][None] >= percent * sizes))
        for at in range(0, len(i), ADMITTED_PAIRS):
            of_set, of_root = i[at : at + ADMITTED_PAIRS] + start, j[at : at + ADMITTED_PAIRS]
            fits, _ = _possible(sets, roots, of_set, of_root, percent)
            yield of_set[fits], of_root[fits]


class Tree:
    """Levels from single sets up to one root. ``sets`` are sorted arrays of distinct tokens, none empty."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        # Like sets lie beside each other: those that share their least token, by size.
        self.order = np.lexsort((sizes, np.array([s[0] for s in sets], np.uint64)))
        self.levels = [signatures([sets[i] for i in self.order.tolist()], bits)]
        while len(self.levels[-1][0]) > 1:
            words, least, most, excess = self.levels[-1]
            starts = np.arange(0, len(words), FAN)
            self.levels.append(
                (np.bitwise_or.reduceat(words, starts, axis=0), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts), np.maximum.reduceat(excess, starts))
            )

    def at(self, level: int) -> tuple[np.ndarray, ...]:
        return self.levels[min(level, len(self.levels) - 1)]


def bits_for(sets: list[np.ndarray]) -> int:
    return int(np.clip(1 << int(SPARSE * max(map(len, sets))).bit_length(), LEAST_BITS, MOST_BITS))


def _possible(one: tuple, other: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which node pairs may hold a link, and the most tokens their sets may share."""
    (words_i, least_i, most_i, excess_i), (words_j, least_j, most_j, excess_j) = one, other
    shared = np.bitwise_count(words_i[i] & words_j[j]).sum(1, dtype=np.int64) + np.minimum(excess_i[i], excess_j[j])
    shared = np.minimum(shared, np.minimum(most_i[i], most_j[j]))
    # percent <= 100 * shared / (a + b - shared) for the smallest a and b there are.
    fits = (100 + percent) * shared >= percent * (least_i[i] + least_j[j])
    fits &= (100 * most_i[i] >= percent * least_j[j]) & (100 * most_j[j] >= percent * least_i[i])
    return fits, shared


def candidates(left: Tree, right: Tree | None, percent: int):
    """Pairs of sets that may be linked, in blocks: positions in left and right (or twice in left), and a bound of what they share.

    Both trees are walked together from their roots; a pair of nodes whose
    bitmaps and sizes allow no link is left with all that is below it.
    """
    other = left if right is None else right
    top = max(len(left.levels), len(other.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > PAIRS:
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        fits, shared = _possible(left.at(level), other.at(level), i, j, percent)
        i, j, shared = i[fits], j[fits], shared[fits]
        if level == 0:
            if right is None:
                i, j, shared = i[i < j], j[i < j], shared[i < j]
            if len(i):
                yield left.order[i], other.order[j], shared
            continue
        i, j = _children(left, level, i, j)
        j, i = _children(other, level, j, i)
        if right is None:
            i, j = i[i <= j], j[i <= j]
        if len(i):
            stack.append((level - 1, i, j))


def _children(tree: Tree, level: int, nodes: np.ndarray, with_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if level >= len(tree.levels):  # the other tree is higher
        return nodes, with_
    below = len(tree.levels[level - 1][0])
    children = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
    return children[children < below], np.repeat(with_, FAN)[children < below]


class Forest:
    """Union-find."""

    def __init__(self, labels: list):
        first: dict = {}
        self.parent = [first.setdefault(label, i) for i, label in enumerate(labels)]

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        self.parent[max(i, j)] = min(i, j)


def spanning_links(sets: list[np.ndarray], labels: list, percent: int, right: list[np.ndarray] | None = None, right_labels: list | None = None) -> list[tuple[int, int]]:
    """Links that connect all that any links connect: between two of sets, or one of sets and one of right.

    Sets with equal labels are known to be connected. A pair that is connected
    already is not compared; likely pairs come first. Positions in right count on
    from those in sets.
    """
    if not sets or right == []:
        return []
    both = sets + (right or [])
    bits = bits_for(both)
    left_tree, right_tree = Tree(sets, bits), Tree(right, bits) if right else None
    offset = len(sets) if right else 0
    forest = Forest(list(labels) + list(right_labels or []))
    links = []
    for i, j, shared in candidates(left_tree, right_tree, percent):
        j = j + offset
        for at in np.argsort(-shared, kind="stable").tolist():
            a, b = int(i[at]), int(j[at])
            root_a, root_b = forest.find(a), forest.find(b)
            if root_a != root_b and linked(both[a], both[b], percent):
                forest.union(root_a, root_b)
                links.append((a, b))
    return links


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)
