from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table."""
    def _docs(rows):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return _docs


def groups(links, nodes):
    """Smallest node reachable from each node, by search."""
    near = {n: set() for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for n in sorted(nodes):
        if n in root:
            continue
        front = [n]
        while front:
            x = front.pop()
            if x not in root:
                root[x] = n
                front.extend(near[x])
    return root
