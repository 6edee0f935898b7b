"""Brute-force helpers."""

from __future__ import annotations


def brute_components(links, vertices):
    """Smallest vertex reachable, by vertex."""
    parent = {v: v for v in vertices}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {v: root(v) for v in vertices}
