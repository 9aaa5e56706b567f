"""Moves of vertices between communities inside one block of a graph.

Blocks are bounded and Spark deals them out; a block sees its vertices, their arcs
and what stands at the far ends of these.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

Near = list[list[tuple[int, float]]]  # (place, weight) of the far ends of each vertex


def _numbered(nodes: pd.DataFrame, arcs: pd.DataFrame) -> tuple[Near, np.ndarray, int]:
    """(far ends of each row of ``nodes``, place of every ``dst``, places): rows of ``nodes``
    have the first places, what lies outside the further ones."""
    own = nodes["vertex"].to_numpy()
    place, every = pd.factorize(np.concatenate([own, arcs["src"].to_numpy(), arcs["dst"].to_numpy()]))
    near: Near = [[] for _ in own]
    src, dst = place[len(own) :].reshape(2, -1)
    for a, b, w in zip(src.tolist(), dst.tolist(), arcs["weight"].tolist()):
        near[a].append((b, w))
    return near, dst, len(every)


def _weights(ends: list[tuple[int, float]], of: list[int]) -> dict[int, float]:
    to: dict[int, float] = {}
    for u, w in ends:
        to[of[u]] = to.get(of[u], 0.0) + w
    return to


def _settle(near: Near, k: list[float], of: list[int], tot: list[float], m2: float, resolution: float, least: float) -> float:
    """What is gained when vertices take turns and join the community next to them that gains the
    most (the least number of equal ones), until a turn of all gains no more than ``least``."""
    total, gained = 0.0, least + 1
    while gained > least:
        gained = 0.0
        for v, ends in enumerate(near):
            to, home, mine = _weights(ends, of), of[v], k[v]
            stay = to.pop(home, 0.0) - resolution * mine * (tot[home] - mine) / m2
            best, gain = home, 0.0
            for c, w in to.items():
                more = round(2.0 * (w - resolution * mine * tot[c] / m2 - stay) / m2, 15)
                if more > gain or (more == gain > 0 and c < best):
                    best, gain = c, more
            if best != home:
                tot[home] -= mine
                tot[best] += mine
                of[v] = best
                gained += gain
        total += gained
    return total


def _refine(near: Near, k: list[float], of: list[int], m2: float, resolution: float) -> list[int]:
    """A piece for each vertex, named by one of its own: a vertex that is still alone joins the
    piece of its community that gains the most, until none can gain."""
    inner = [[(u, w) for u, w in ends if of[u] == of[v]] for v, ends in enumerate(near)]
    sub, tot, size = list(range(len(k))), list(k), [1] * len(k)
    moved = True
    while moved:
        moved = False
        for v, ends in enumerate(inner):
            if size[v] != 1 or sub[v] != v:
                continue
            best, gain = v, 0.0
            for s, w in _weights(ends, sub).items():
                more = round(w - resolution * k[v] * tot[s] / m2, 12)
                if more > gain or (more == gain > 0 and s < best):
                    best, gain = s, more
            if best != v:
                sub[v], size[v], moved = best, 0, True
                tot[best] += k[v]
                size[best] += 1
    return sub


def settle_block(nodes: pd.DataFrame, arcs: pd.DataFrame, m2: float, resolution: float, least: float) -> pd.DataFrame:
    """(vertex, k, community): ``nodes`` (vertex, k, community, tot) after moves. ``arcs`` (src,
    dst, weight, cand, tot) lead from them to any vertex; one outside the block stays in ``cand``."""
    nodes, arcs = nodes.sort_values("vertex"), arcs.sort_values(["src", "dst"])
    near, dst, places = _numbered(nodes, arcs)
    number, known = pd.factorize(np.concatenate([nodes["community"].to_numpy(), arcs["cand"].to_numpy()]), sort=True)
    tot, of = np.zeros(len(known)), np.zeros(places, np.int64)
    tot[number] = np.concatenate([nodes["tot"].to_numpy(), arcs["tot"].to_numpy()])
    of[dst] = number[len(nodes) :]
    of[: len(nodes)] = number[: len(nodes)]
    moved = of.tolist()
    _settle(near, nodes["k"].tolist(), moved, tot.tolist(), m2, resolution, least)
    return pd.DataFrame({"vertex": nodes["vertex"], "k": nodes["k"], "community": known[moved[: len(nodes)]]})


def refine_block(nodes: pd.DataFrame, arcs: pd.DataFrame, m2: float, resolution: float) -> pd.DataFrame:
    """(vertex, k, community, sub): whole communities of ``nodes`` (vertex, k, community) as
    connected pieces. ``arcs`` (src, dst, weight) stay inside a community."""
    nodes, arcs = nodes.sort_values("vertex"), arcs.sort_values(["src", "dst"])
    near, _, _ = _numbered(nodes, arcs)
    sub = _refine(near, nodes["k"].tolist(), [0] * len(nodes), m2, resolution)
    return pd.DataFrame({"vertex": nodes["vertex"], "k": nodes["k"], "community": nodes["community"], "sub": nodes["vertex"].to_numpy()[sub]})


def search_block(nodes: pd.DataFrame, arcs: pd.DataFrame, m2: float, resolution: float, least: float) -> pd.DataFrame:
    """(vertex, community, settled, was): a level that fits one block, with all levels above it.

    ``nodes`` is (vertex, k, community) and ``arcs`` (src, dst, weight); ``settled`` is the
    community after the moves of single vertices, which count if they gain more than ``least``.
    """
    nodes, arcs = nodes.sort_values("vertex"), arcs.sort_values(["src", "dst"])
    near, _, _ = _numbered(nodes, arcs)
    number, known = pd.factorize(nodes["community"].to_numpy(), sort=True)
    k, of, at, settled = nodes["k"].tolist(), number.tolist(), np.arange(len(nodes)), None
    while True:
        before = list(of)
        if _settle(near, k, of, np.bincount(of, k, len(known)).tolist(), m2, resolution, least / 2) <= least:
            of = before
        settled = np.array(of) if settled is None else settled
        sub = _refine(near, k, of, m2, resolution)
        piece, heads = pd.factorize(np.array(sub))
        if len(heads) == len(sub):
            break
        links: list[dict[int, float]] = [{} for _ in heads]
        for v, ends in enumerate(near):
            for u, w in ends:
                if piece[u] != piece[v]:
                    links[piece[v]][piece[u]] = links[piece[v]].get(piece[u], 0.0) + w
        near, k, of, at = [list(x.items()) for x in links], np.bincount(piece, k).tolist(), [of[h] for h in heads], piece[at]
    return pd.DataFrame({"vertex": nodes["vertex"], "community": known[np.array(of)[at]], "settled": known[settled], "was": nodes["community"]})


def connected_block(nodes: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
    """(vertex, community): the least vertex that ``arcs`` (src, dst) reach from each of ``nodes`` (vertex)."""
    nodes = nodes.sort_values("vertex")
    near, _, _ = _numbered(nodes, arcs.assign(weight=1.0))
    low = [-1] * len(near)
    for v in range(len(near)):
        todo = [v] if low[v] < 0 else []
        while todo:
            u = todo.pop()
            if low[u] < 0:
                low[u] = v
                todo += [x for x, _ in near[u]]
    return pd.DataFrame({"vertex": nodes["vertex"], "community": nodes["vertex"].to_numpy()[low]})
