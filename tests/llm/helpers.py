from __future__ import annotations


def components(values: list[int], distance: int) -> list[int]:
    """For each value the first one that links within ``distance`` bits lead to."""
    root = list(range(len(values)))

    def follow(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i + 1, len(values)):
            if (a ^ values[j]).bit_count() <= distance:
                x, y = follow(i), follow(j)
                root[max(x, y)] = min(x, y)
    return [follow(i) for i in range(len(values))]
