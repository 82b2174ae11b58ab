"""A BK-tree: all entries within a distance of a query, found by the triangle inequality."""

from __future__ import annotations


class Pattern:
    """A query string prepared for many Levenshtein distances, computed on the bits of whole columns at once."""

    def __init__(self, text: str):
        self.text, self.masks = text, {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, other: str) -> int:
        """Insertions, deletions and substitutions between the query and ``other``."""
        m = len(self.text)
        if not m:
            return len(other)
        up, down, score, last, full, masks = (1 << m) - 1, 0, m, 1 << (m - 1), (1 << m) - 1, self.masks
        for c in other:
            match = masks.get(c, 0)
            diagonal = (((match & up) + up) ^ up) | match | down
            rise = down | ~(diagonal | up) & full
            fall = up & diagonal
            if rise & last:
                score += 1
            elif fall & last:
                score -= 1
            rise = rise << 1 | 1
            up = (fall << 1 | ~(diagonal | rise)) & full
            down = rise & diagonal
        return score


def one_edit(a: str, b: str) -> bool:
    """Whether ``b`` is ``a`` or differs by one inserted, deleted or changed character or one swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


class BKTree:
    """Strings under Levenshtein distance, a metric; the children of a node are keyed by their distance to it."""

    def __init__(self, entries: list[str] | tuple[str, ...] = ()):
        self.root: tuple[str, dict] | None = None
        for entry in entries:
            self.add(entry)

    def add(self, entry: str) -> None:
        if self.root is None:
            self.root = (entry, {})
            return
        pattern, node = Pattern(entry), self.root
        while True:
            d = pattern.distance(node[0])
            if not d:
                return
            if d not in node[1]:
                node[1][d] = (entry, {})
                return
            node = node[1][d]

    def within(self, query: str, threshold: int) -> list[tuple[int, str]]:
        """``(distance, entry)`` of every entry within the threshold, nearest first, then in order of the strings."""
        found, open_, pattern = [], [self.root] if self.root else [], Pattern(query)
        while open_:
            entry, children = open_.pop()
            d = pattern.distance(entry)
            if d <= threshold:
                found.append((d, entry))
            low, high = d - threshold, d + threshold
            open_ += [child for edge, child in children.items() if low <= edge <= high]
        return sorted(found)
