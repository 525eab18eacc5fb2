"""Strong components of a graph that fits a task, and a shortest cycle through the least node of each.

Nodes are numbered ``0 .. nodes - 1``; a component goes by its least number.  Time
and memory are linear in nodes and links, however long a path or a cycle is.
"""

from __future__ import annotations

from array import array

import numpy as np

# Waves of at most so many nodes are not worth a step over arrays.
FEW = 64


def linked(src: np.ndarray, dst: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all links by their start, and where those of each node begin (one more for the end)."""
    return dst[np.argsort(src, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(src, minlength=nodes))])


def component_of(src: np.ndarray, dst: np.ndarray, nodes: int) -> np.ndarray:
    """Least node of the component of each node."""
    inside = _peeled(src, dst, nodes) & _peeled(dst, src, nodes)
    stay = np.flatnonzero(inside)
    number = np.cumsum(inside) - 1
    kept = inside[src] & inside[dst]
    found = _visited(number[src[kept]], number[dst[kept]], len(stay))
    out = np.arange(nodes)
    if len(stay):
        least = np.full(len(stay), len(stay), np.int64)
        np.minimum.at(least, found, np.arange(len(stay)))
        out[stay] = stay[least[found]]
    return out


def _peeled(src: np.ndarray, dst: np.ndarray, nodes: int) -> np.ndarray:
    """Nodes left when those without a link in go, wave by wave, while the waves are large."""
    near, first = linked(src, dst, nodes)
    open_links = np.bincount(dst, minlength=nodes)
    wave = np.flatnonzero(open_links == 0)
    left = np.ones(nodes, bool)
    left[wave] = False
    while len(wave) > FEW:
        many = first[wave + 1] - first[wave]
        ends = near[np.repeat(first[wave + 1] - np.cumsum(many), many) + np.arange(many.sum())]
        ends, times = np.unique(ends, return_counts=True)
        open_links[ends] -= times
        wave = ends[open_links[ends] == 0]
        left[wave] = False
    return left


def _visited(src: np.ndarray, dst: np.ndarray, nodes: int) -> np.ndarray:
    """Some node of the component of each node, from one depth-first walk (Tarjan)."""
    ends, starts = linked(src, dst, nodes)
    near, ahead, last = array("q", ends.astype(np.int64).tobytes()), array("q", starts[:-1].astype(np.int64).tobytes()), array("q", starts[1:].astype(np.int64).tobytes())
    home, low, order = array("q", bytes(8 * nodes)), array("q", bytes(8 * nodes)), array("q", bytes(8 * nodes))
    closed, count = nodes + 1, 0  # what a node of a finished component has as its lowest place
    path, waiting = array("q"), array("q")
    for root in range(nodes):
        if order[root]:
            continue
        count += 1
        order[root] = low[root] = count
        path.append(root)
        waiting.append(root)
        while path:
            at = path[-1]
            link = ahead[at]
            if link < last[at]:
                ahead[at] = link + 1
                end = near[link]
                if not order[end]:
                    count += 1
                    order[end] = low[end] = count
                    path.append(end)
                    waiting.append(end)
                elif low[end] < low[at]:
                    low[at] = low[end]
                continue
            path.pop()
            if low[at] == order[at]:
                while True:
                    member = waiting.pop()
                    home[member] = at
                    low[member] = closed
                    if member == at:
                        break
            elif low[at] < low[path[-1]]:
                low[path[-1]] = low[at]
    return np.frombuffer(home, np.int64) if nodes else np.zeros(0, np.int64)


def least_cycles(src: np.ndarray, dst: np.ndarray, nodes: int, homes: np.ndarray) -> list[list[int]]:
    """For each of ``homes`` the shortest cycle through it, the first by its nodes among equals.

    Links must lie within components, and each component must hold one home at most.
    """
    ends, starts = linked(dst, src, nodes)
    back, begin = array("q", ends.astype(np.int64).tobytes()), array("q", starts.astype(np.int64).tobytes())
    # Distance to the home of the component; homes and what reaches none keep -1.
    rest = array("q", np.full(nodes, -1, np.int64).tobytes())
    is_home = np.zeros(nodes, bool)
    is_home[homes] = True
    wave, depth = array("q", homes.astype(np.int64).tobytes()), 0
    while wave:
        depth += 1
        met = array("q")
        for at in wave:
            for link in range(begin[at], begin[at + 1]):
                node = back[link]
                if rest[node] < 0 and not is_home[node]:
                    rest[node] = depth
                    met.append(node)
        wave = met
    left = np.frombuffer(rest, np.int64) if nodes else np.zeros(0, np.int64)
    # Of all links that come one step nearer, a node takes the one to the least node; from a home the nearest nodes count.
    near = np.where(is_home[dst], 0, left[dst])
    useful = np.where(is_home[src], True, near == left[src] - 1) & (is_home[dst] | (left[dst] >= 0))
    rows = np.lexsort((dst[useful], near[useful], src[useful]))
    start, end = src[useful][rows], dst[useful][rows]
    first = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]])) if len(start) else np.zeros(0, np.int64)
    onward = np.full(nodes, -1, np.int64)
    onward[start[first]] = end[first]
    steps = array("q", onward.tobytes())
    out = []
    for home in homes.tolist():
        cycle, at = [home], steps[home]
        while at >= 0 and at != home:
            cycle.append(at)
            at = steps[at]
        out.append([*cycle, home] if at == home else [])
    return out
