"""Minimum cut of a small labelling graph (Dinic), after fixing nodes whose own cost outweighs all their edges."""

from __future__ import annotations

from collections import deque


def min_cut(score: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels that minimise the costs of nodes (-score where labelled False, score > 0; and the reverse) plus the
    weights of edges between different labels.  On a tie a node is labelled False.
    """
    n = len(score)
    around: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            around[a][b] = around[a].get(b, 0) + w
            around[b][a] = around[b].get(a, 0) + w
    score = list(score)
    label: list[bool | None] = [None] * n
    # a node that outweighs its edges takes its own side in every minimum cut; its edges then add to its neighbours
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if label[v] is not None or abs(score[v]) <= sum(around[v].values()) and around[v]:
            continue
        label[v] = score[v] > 0
        for u, w in around[v].items():
            score[u] += w if label[v] else -w
            del around[u][v]
            todo.append(u)
        around[v] = {}
    for v in range(n):
        if label[v] is None:
            part, stack, seen = [], [v], {v}
            while stack:
                x = stack.pop()
                part.append(x)
                for u in around[x]:
                    if u not in seen:
                        seen.add(u)
                        stack.append(u)
            for x, side in zip(part, _cut(part, score, around), strict=True):
                label[x] = side
    return [bool(x) for x in label]


def _cut(part: list[int], score: list[int], around: list[dict[int, int]]) -> list[bool]:
    n = len(part)
    at = {v: i for i, v in enumerate(part)}
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, v in enumerate(part):
        if score[v] > 0:
            add(source, i, score[v], 0)
        elif score[v] < 0:
            add(i, sink, -score[v], 0)
        for u, w in around[v].items():
            if at[u] > i:
                add(i, at[u], w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                push = min(cap[e] for e in path)
                first = 0
                for k in range(len(path) - 1, -1, -1):
                    e = path[k]
                    cap[e] -= push
                    cap[e ^ 1] += push
                    if not cap[e]:
                        first = k
                x = to[path[first] ^ 1]
                del path[first:]
                continue
            while tried[x] < len(out[x]):
                e = out[x][tried[x]]
                if cap[e] and level[to[e]] == level[x] + 1:
                    break
                tried[x] += 1
            else:
                if x == source:
                    break
                e = path.pop()
                x = to[e ^ 1]
                tried[x] += 1
                continue
            path.append(e)
            x = to[e]
