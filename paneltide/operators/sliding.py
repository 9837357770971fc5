"""Distances from a sliding window's mean, with the inverse of its scatter carried from row to row."""

from __future__ import annotations

import numpy as np

#: Rows after which the inverse is computed anew; a residual over TOLERANCE does so earlier.
EVERY, TOLERANCE = 32, 1e-10
#: A scatter with a larger condition number is left to the pseudo-inverse.
CONDITION = 1e8


class Scatter:
    """Mean, scatter and inverse scatter of the rows x[end - window:end] of the columns that are used."""

    def __init__(self, x: np.ndarray, end: int, window: int):
        past = x[end - window : end]
        self.end, self.window, self.age = end, window, 0
        self.mean = past.mean(0)
        self.scatter = (past - self.mean).T @ (past - self.mean)
        size = len(self.mean)
        self.sound = window - 1 > size and np.linalg.cond(self.scatter) < CONDITION
        self.inverse = np.linalg.inv(self.scatter) if self.sound else None

    def step(self, x: np.ndarray) -> None:
        """The next row comes in and the oldest goes: three rank-one terms, squares of the places of two rows and the mean's move."""
        new, old, n = x[self.end], x[self.end - self.window], self.window
        u = np.column_stack([new - self.mean, old - self.mean, new - old])
        signs = np.array([1.0, -1.0, -1.0 / n])
        iu = self.inverse @ u
        self.inverse = self.inverse - iu @ np.linalg.solve(np.diag(1 / signs) + u.T @ iu, iu.T)
        self.scatter = self.scatter + (u * signs) @ u.T
        self.mean = self.mean + (new - old) / n
        self.end, self.age = self.end + 1, self.age + 1

    def distance(self, row: np.ndarray, x: np.ndarray) -> float | None:
        """d C^+ d of d = row - mean and the covariance C; None if the carried inverse has worn off."""
        d = row - self.mean
        if not self.sound:
            return float(d @ np.linalg.pinv(np.atleast_2d(np.cov(x[self.end - self.window : self.end], rowvar=False))) @ d)
        z = self.inverse @ d
        if self.age and not np.abs(self.scatter @ z - d).max() <= TOLERANCE * np.abs(d).max():
            return None
        return float((self.window - 1) * (d @ z))


def distances(x: np.ndarray, wanted: np.ndarray, window: int) -> list[float | None]:
    """For each of the ascending rows `wanted` (at least `window`): its distance from the rows before it over the columns that are whole in
    both; None for fewer than two such columns. A step costs the square of the columns, not their cube."""
    gaps = np.vstack([np.zeros((1, x.shape[1]), int), np.cumsum(np.isnan(x), axis=0)])
    out, held, used = [], None, None
    for at in wanted:
        good = gaps[at + 1] == gaps[at - window]
        if good.sum() < 2:
            out.append(None)
            continue
        if used is None or (good != used).any():
            used, part, held = good, x[:, good], None
        if held is not None and held.sound and held.age + at - held.end <= EVERY:
            try:
                while held.end < at:
                    held.step(part)
                value = held.distance(part[at], part)
            except np.linalg.LinAlgError:
                value = None
        else:
            value = None
        if value is None:
            held = Scatter(part, at, window)
            value = held.distance(part[at], part)
        out.append(value)
    return out
