"""Chances of winning from every score, for arrays of rows.

From any score the rest of a match is a small grid: points of a game or a
tiebreak, games of a set, sets of a match. The grids are filled backwards, each
cell one array over the rows.
"""

from __future__ import annotations

import numpy as np

from duelframe.session import ship

ship(__name__)

# fixed values
NEUTRAL = 0.5
EDGE = 0.01
TIEBREAK_LIMIT = 60
#: How a set can end: A or B wins it, and who serves first in the next one.
ENDS = ("win_A", "win_B", "lose_A", "lose_B")
SIDES = (0, 1)  # A and B as servers


def serves_first_tiebreak(i: int) -> bool:
    """Does the player who opened the tiebreak serve point i?"""
    return i == 0 or (i - 1) // 2 % 2 == 1


def hold_chance(p: np.ndarray) -> np.ndarray:
    """P(server wins a game) from P(server wins a point)."""
    return np.clip(p**4 * (15.0 - 34.0 * p + 28.0 * p**2 - 8.0 * p**3) / (1.0 - 2.0 * p + 2.0 * p**2), 0.0, 1.0)


def two_clear(x: np.ndarray, y: np.ndarray, rounds: np.ndarray | float) -> np.ndarray:
    """P(A goes two ahead from level) in so many rounds won with x and lost with y, then a coin toss."""
    again = (1.0 - x - y) ** rounds
    return x / (x + y) * (1.0 - again) + NEUTRAL * again


def game_grid(p: np.ndarray) -> np.ndarray:
    """P(A wins the game) by points of A and B up to 3, with p = P(A wins a point)."""
    deuce = p**2 / (p**2 + (1 - p) ** 2)
    grid = np.empty((4, 4, len(p)))
    for x in range(3, -1, -1):
        for y in range(3, -1, -1):
            won = grid[x + 1, y] if x < 3 else 1.0
            lost = grid[x, y + 1] if y < 3 else 0.0
            grid[x, y] = deuce if x == y == 3 else p * won + (1 - p) * lost
    return grid


def tiebreak_grid(pa: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """P(A wins the tiebreak) by opener and points up to 6-6."""
    level = two_clear(pa * (1 - pb), (1 - pa) * pb, (TIEBREAK_LIMIT - 12) // 2)
    grid = np.empty((2, 7, 7, len(pa)))
    for opener in SIDES:
        for x in range(6, -1, -1):
            for y in range(6, -1, -1):
                if x == y == 6:
                    grid[opener, x, y] = level
                    continue
                a_serves = serves_first_tiebreak(x + y) == (opener == 0)
                p = pa if a_serves else 1 - pb
                won = grid[opener, x + 1, y] if x < 6 else 1.0
                lost = grid[opener, x, y + 1] if y < 6 else 0.0
                grid[opener, x, y] = p * won + (1 - p) * lost
    return grid


def set_grid(ha: np.ndarray, hb: np.ndarray, tiebreak: np.ndarray) -> np.ndarray:
    """Chances of the four ends by games of A and B and the next server; ``tiebreak`` by opener."""
    grid = np.zeros((7, 7, 2, 4, len(ha)))

    def after(x: int, y: int, server: int) -> np.ndarray:
        if max(x, y) >= 6 and abs(x - y) >= 2:
            end = np.zeros((4, len(ha)))
            end[server if x > y else 2 + server] = 1.0
            return end
        return grid[x, y, server]

    for x in range(6, -1, -1):
        for y in range(6, -1, -1):
            if max(x, y) >= 6 and abs(x - y) >= 2:
                continue
            for server in SIDES:
                other = 1 - server
                if x == y == 6:  # the next server opens the tiebreak, the other one the next set
                    grid[x, y, server, other] = tiebreak[server]
                    grid[x, y, server, 2 + other] = 1.0 - tiebreak[server]
                else:
                    p = ha if server == 0 else 1 - hb
                    grid[x, y, server] = p * after(x + 1, y, other) + (1 - p) * after(x, y + 1, other)
    return grid


def match_grid(start: np.ndarray) -> np.ndarray:
    """P(A wins the match) by sets that A and B still need (0 to 3) and the server of the next set.

    ``start``: chances of the four ends of a new set by its first server.
    """
    grid = np.zeros((4, 4, 2, start.shape[-1]))
    grid[0] = 1.0
    for i in range(1, 4):
        for j in range(1, 4):
            for server in SIDES:
                end = start[server]
                grid[i, j, server] = sum(end[t] * grid[i - 1, j, t] + end[2 + t] * grid[i, j - 1, t] for t in SIDES)
    return grid
