"""Tracks of boxes of which many are equal: those whose last boxes are alike go on together.

Tracks are numbered in the order in which they began. A piece is a tuple (number of its first track, how many tracks
follow on it by number, and what else is the same for all of them). A frame costs as many steps as it has different
boxes and pieces, however many copies there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from parkflow.operators.overlap import met

Pieces = list[tuple]


def _front(pieces: Pieces, n: int) -> tuple[Pieces, Pieces]:
    """The first n tracks, and the others."""
    for j, p in enumerate(pieces):
        if p[1] > n:
            own = [*pieces[:j], (p[0], n, *p[2:])] if n else pieces[:j]
            return own, [(p[0] + n, p[1] - n, *p[2:]), *pieces[j + 1 :]]
        n -= p[1]
    return pieces, []


def _joined(pieces: Pieces) -> Pieces:
    """In the order of numbers, those that follow on one another as one."""
    if len(pieces) == 1:
        return pieces
    out: Pieces = []
    for p in sorted(pieces):
        if out and out[-1][0] + out[-1][1] == p[0] and out[-1][2:] == p[2:]:
            out[-1] = (out[-1][0], out[-1][1] + p[1], *p[2:])
        else:
            out.append(p)
    return out


def _sound_pairs(live: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `met`; boxes that aren't finite meet none."""
    a, b = (np.flatnonzero(np.isfinite(v).all(axis=1)) for v in (own, live))
    i, k, iou = met(live[b], own[a], least)
    return a[i], b[k], iou


def _dealt(live: np.ndarray, held: list[Pieces], own: np.ndarray, many: list[int], least: float, each: int = 4096) -> list[Pieces]:
    """The tracks that go on with each of the boxes own[i], of which there are many[i], in the order in which the copies
    get them; they are taken out of held[k], the tracks that ended with the box live[k].

    Those that overlap most go together first; of equal overlaps the boxes are in their order, then the tracks in that
    of their numbers."""
    i, k, iou = _sound_pairs(live, own, least)
    given: list[Pieces] = [[] for _ in many]
    free = list(many)
    order = np.lexsort((i, -iou))
    i, k, iou = i[order], k[order], iou[order]
    while len(i):
        end = min(each, len(i))
        while end < len(i) and i[end] == i[end - 1] and iou[end] == iou[end - 1]:
            end += 1
        boxes, near = i[:end].tolist(), k[:end].tolist()
        ends = (np.flatnonzero((i[1:end] != i[: end - 1]) | (iou[1:end] != iou[: end - 1])) + 1).tolist()
        begin = 0
        for stop in (*ends, end):
            g, units, begin = boxes[begin], near[begin:stop], stop
            if not free[g]:
                continue
            if len(units) == 1:
                took, held[units[0]] = _front(held[units[0]], free[g])
                given[g] += took
                free[g] -= sum(p[1] for p in took)
                continue
            pool = sorted((p, u) for u in units for p in held[u])
            for u in units:
                held[u] = []
            for p, u in pool:
                n = min(free[g], p[1])
                if n:
                    given[g].append((p[0], n, *p[2:]))
                    free[g] -= n
                if n < p[1]:
                    held[u].append((p[0] + n, p[1] - n, *p[2:]))
        i, k, iou = i[end:], k[end:], iou[end:]
        if len(i):
            left = np.array(free)[i] > 0
            left &= np.array([len(p) > 0 for p in held])[k]
            i, k, iou = i[left], k[left], iou[left]
    return given


class Bundles:
    """Live tracks: box[k] is the last box of the pieces held[k], at[k] (a row of numbers) when that was."""

    def __init__(self, box: np.ndarray, at: np.ndarray, held: list[Pieces]):
        self.box, self.at, self.held = box, at, held

    @classmethod
    def of(cls, box: np.ndarray, at: np.ndarray, pieces: Pieces) -> Bundles:
        """From single pieces, in the order of their numbers, with a box and a time each."""
        alike, where = np.unique(np.column_stack([box, at]), axis=0, return_inverse=True)
        held: list[Pieces] = [[] for _ in alike]
        for u, p in zip(where.ravel().tolist(), pieces):
            held[u].append(p)
        return cls(alike[:, :4].astype(float), alike[:, 4:].astype(at.dtype), [_joined(p) for p in held])

    def single(self) -> tuple[np.ndarray, np.ndarray, Pieces]:
        """What `of` takes."""
        every = sorted((p, u) for u, own in enumerate(self.held) for p in own)
        where = np.array([u for _, u in every], dtype="int64")
        return self.box[where], self.at[where], [p for p, _ in every]

    def leave(self, stays: np.ndarray) -> tuple[np.ndarray, list[Pieces]]:
        """Only some of the bundles stay: the times and pieces of the others."""
        gone = np.flatnonzero(~stays)
        if not len(gone):
            return self.at[:0], []
        out = self.at[gone], [self.held[u] for u in gone]
        self.box, self.at, self.held = self.box[stays], self.at[stays], [p for p, s in zip(self.held, stays.tolist()) if s]
        return out

    def follow(self, own: np.ndarray, at: np.ndarray, many: list[int], least: float, new: int, begun: tuple = (), on: Callable[[tuple], tuple] | None = None) -> tuple[list[Pieces], int]:
        """The tracks of the boxes own[i], many[i] of each, seen at `at`, in the order of the copies, and the next number.
        Boxes that no track goes on with begin some, numbered from `new` on; `begun` is what is kept of these, on(piece)
        the piece after another box. own has no box twice and is in order."""
        given = _dealt(self.box, self.held, own, many, least)
        self.leave(np.array([len(p) > 0 for p in self.held], dtype=bool))
        for g, n in enumerate(many):
            pieces = [on(p) for p in given[g]] if on else given[g]
            fresh = n - sum(p[1] for p in pieces)
            if fresh:
                pieces = [*pieces, (new, fresh, *begun)]
                new += fresh
            given[g] = pieces
        self.box, self.at = np.concatenate([self.box, own]), np.concatenate([self.at, np.tile(at, (len(own), 1))])
        self.held += [_joined(p) for p in given]
        return given, new
