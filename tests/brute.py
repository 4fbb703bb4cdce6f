"""Score-by-score recursions to check the closed forms against."""

from __future__ import annotations

import sys
from functools import lru_cache

sys.setrecursionlimit(10_000)
LABELS = {"0": 0, "15": 1, "30": 2, "40": 3, "AD": 4}


def other(s):
    return "B" if s == "A" else "A"


def tb_server(i, first):
    order = [first] + [other(first), other(first), first, first] * 40
    return order[i]


def point(server, pa, pb):
    return pa if server == "A" else 1 - pb


@lru_cache(None)
def game(a, b, p):
    """Long games are followed for 400 points, which leaves nothing to speak of."""
    prob = {(a, b): 1.0}
    won = 0.0
    for _ in range(400):
        step = {}
        for (x, y), w in prob.items():
            for nx, ny, q in ((x + 1, y, p), (x, y + 1, 1 - p)):
                if max(nx, ny) >= 4 and abs(nx - ny) >= 2:
                    won += w * q if nx > ny else 0.0
                else:
                    step[nx, ny] = step.get((nx, ny), 0.0) + w * q
        prob = step
        if not prob:
            break
    return won


@lru_cache(None)
def tiebreak(a, b, first, pa, pb):
    if a >= 7 and a - b >= 2:
        return 1.0
    if b >= 7 and b - a >= 2:
        return 0.0
    if a + b >= 60:
        return 0.5
    p = point(tb_server(a + b, first), pa, pb)
    return p * tiebreak(a + 1, b, first, pa, pb) + (1 - p) * tiebreak(a, b + 1, first, pa, pb)


@lru_cache(None)
def from_game(sa, sb, ga, gb, server, pa, pb, target):
    """At the start of a game."""
    if sa == target:
        return 1.0
    if sb == target:
        return 0.0
    if ga == gb == 6:
        w = tiebreak(0, 0, server, pa, pb)
        return w * from_game(sa + 1, sb, 0, 0, other(server), pa, pb, target) + (1 - w) * from_game(
            sa, sb + 1, 0, 0, other(server), pa, pb, target
        )
    g = game(0, 0, point(server, pa, pb))
    return g * after(sa, sb, ga + 1, gb, server, pa, pb, target) + (1 - g) * after(sa, sb, ga, gb + 1, server, pa, pb, target)


def after(sa, sb, ga, gb, server, pa, pb, target):
    if max(ga, gb) >= 6 and abs(ga - gb) >= 2:
        sa, sb, ga, gb = (sa + 1, sb, 0, 0) if ga > gb else (sa, sb + 1, 0, 0)
    return from_game(sa, sb, ga, gb, other(server), pa, pb, target)


def match(sa, sb, ga, gb, a, b, server, pa, pb, best_of):
    target = best_of // 2 + 1
    a, b = LABELS.get(a, a), LABELS.get(b, b)
    a, b = int(a), int(b)
    if ga == gb == 6:
        first = server if tb_server(a + b, "A") == "A" else other(server)
        w = tiebreak(a, b, first, pa, pb)
        return w * from_game(sa + 1, sb, 0, 0, other(first), pa, pb, target) + (1 - w) * from_game(
            sa, sb + 1, 0, 0, other(first), pa, pb, target
        )
    g = game(a, b, point(server, pa, pb))
    return g * after(sa, sb, ga + 1, gb, server, pa, pb, target) + (1 - g) * after(sa, sb, ga, gb + 1, server, pa, pb, target)


def prematch(pa, pb, best_of):
    def clip(x):
        return min(max(x, 0.01), 0.99)

    pa, pb = clip(pa), clip(pb)
    ha, hb = clip(game(0, 0, pa)), clip(game(0, 0, pb))

    def one_set(first):
        @lru_cache(None)
        def rec(ga, gb):
            if max(ga, gb) >= 6 and abs(ga - gb) >= 2:
                return float(ga > gb)
            if ga == gb == 6:
                return tiebreak(0, 0, first, pa, pb)
            server = first if (ga + gb) % 2 == 0 else other(first)
            g = ha if server == "A" else 1 - hb
            return g * rec(ga + 1, gb) + (1 - g) * rec(ga, gb + 1)

        return rec(0, 0)

    def whole(s):
        @lru_cache(None)
        def rec(i, j):
            if i == best_of // 2 + 1:
                return 1.0
            if j == best_of // 2 + 1:
                return 0.0
            return s * rec(i + 1, j) + (1 - s) * rec(i, j + 1)

        return rec(0, 0)

    return (whole(clip(one_set("A"))) + whole(clip(one_set("B")))) / 2
