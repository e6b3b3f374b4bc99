"""Boxes that overlap, by numpy within a task."""

from __future__ import annotations

import numpy as np


def met(live: np.ndarray, own: np.ndarray, least: float, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, k and IoU of the boxes own[i] and live[k] (rows x, y, w, h) that overlap by `least` or more (0: at all). Boxes
    meet by bands of y and in them by a range of x; no more than about `most` are compared at once."""
    n = max(1, len(live))
    wide, tall = (np.fmax.reduce(live[:, c], initial=0) for c in (2, 3))
    band = np.fmax.reduce(own[:, 3], initial=tall)
    whole = np.isfinite(band) and band > 0
    in_band = lambda y: np.clip(np.floor(np.nan_to_num(y / band)), -(2**31), 2**31).astype("int64") if whole else np.zeros(len(y), "int64")
    by_x = np.argsort(live[:, 0], kind="stable")
    xs = live[by_x, 0]
    place = np.empty(len(live), "int64")
    place[by_x] = np.arange(len(live))
    place += in_band(live[:, 1]) * n
    order = np.argsort(place)
    place, lived = place[order], live[order]
    first = in_band(own[:, 1] - tall)
    bands = np.maximum(in_band(own[:, 1] + own[:, 3]) - first + 1, 0)
    each = np.repeat(np.arange(len(own)), bands)
    level = (np.arange(len(each)) - np.repeat(np.cumsum(bands) - bands, bands) + first[each]) * n
    low = np.searchsorted(place, level + np.searchsorted(xs, own[:, 0] - wide, side="left")[each], side="left")
    many = np.maximum(np.searchsorted(place, level + np.searchsorted(xs, own[:, 0] + own[:, 2], side="left")[each], side="left") - low, 0)
    ends, out, at = np.cumsum(many), [], 0
    while at < len(each):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        size = many[at:end]
        i = np.repeat(each[at:end], size)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[at:end], size)
        p, q = own[i], lived[k]
        across = np.minimum(p[:, 0] + p[:, 2], q[:, 0] + q[:, 2]) - np.maximum(p[:, 0], q[:, 0])
        down = np.minimum(p[:, 1] + p[:, 3], q[:, 1] + q[:, 3]) - np.maximum(p[:, 1], q[:, 1])
        both = np.maximum(across, 0) * np.maximum(down, 0)
        union = p[:, 2] * p[:, 3] + q[:, 2] * q[:, 3] - both
        hit = (both > 0) & (union > 0)
        i, k, iou = i[hit], k[hit], both[hit] / union[hit]
        near = iou >= least if least > 0 else iou > 0
        out.append((i[near], order[k[near]], iou[near]))
        at = end
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))
