"""Point identities through an ordered stream of frames: a pure step on arrays, and the stateful stream around it.

The step is numpy because a stream's frames depend on each other and the free
slots are a stack; parallelism is over streams.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.scan import ranked, recurrence
from tessera.session import scratch


@dataclass
class Options:
    ema: float = 0.9
    max_count_rate: float = 0.05
    tau_hot: float = 0.9
    tau_cold: float = 0.5
    patience: int = 12
    churn_fraction: float = 0.002
    blend: float = 0.1
    lloyd: int = 3


@dataclass
class State:
    """What a stream carries from frame to frame."""

    frame: int = 0
    smoothed: float = 0.0
    next_id: int = 0
    kept: int = 0
    ids: list = field(default_factory=list)
    slots: list = field(default_factory=list)
    strikes: list = field(default_factory=list)
    old: list = field(default_factory=list)
    x: list = field(default_factory=list)
    y: list = field(default_factory=list)
    free: list = field(default_factory=list)
    history: dict = field(default_factory=dict)
    closed: bool = False

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(text: str) -> State:
        return State(**json.loads(text))


def hilbert_order(width: int, height: int) -> np.ndarray:
    """Pixels in the order of the Hilbert curve of the enclosing power-of-two square."""
    side = 1 << max(0, max(width, height) - 1).bit_length()
    p = np.arange(width * height)
    x, y, d = p % width, p // width, np.zeros(width * height, np.int64)
    s = side // 2
    while s:
        rx, ry = (x & s) > 0, (y & s) > 0
        d += s * s * np.where(rx, np.where(ry, 2, 3), np.where(ry, 1, 0))
        flip = rx & ~ry
        fx, fy = np.where(flip, s - 1 - x, x), np.where(flip, s - 1 - y, y)
        x, y = np.where(ry, x, fy), np.where(ry, y, fx)
        s //= 2
    return np.argsort(d, kind="stable")


def hilbert_seeds(density: np.ndarray, width: int, height: int, n: int) -> np.ndarray:
    """``n`` points at the centroids of stretches of equal mass along the curve."""
    order = hilbert_order(width, height)
    m = np.maximum(density[order].astype(np.float64), 0)
    px, py = order % width + 0.5, order // width + 0.5
    sums = np.concatenate([[np.zeros(3)], np.cumsum(np.stack([m, m * px / width, m * py / height], 1), axis=0)])
    total, size = sums[-1, 0], len(order)
    if total <= 1e-12:
        cuts = size * np.arange(n + 1) // n
    else:
        cuts = np.searchsorted(sums[1:, 0], total * np.arange(n + 1) / n, "right")
        cuts[0], cuts[-1] = 0, size
    out = np.empty((n, 2))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = sums[b] - sums[a]
        if part[0] > 1e-12:
            out[i] = part[1:] / part[0]
        elif total <= 1e-12 and b > a:
            out[i] = px[a:b].mean() / width, py[a:b].mean() / height
        else:
            at = order[min(a, size - 1)]
            out[i] = (at % width + 0.5) / width, (at // width + 0.5) / height
    return np.clip(out, 0, 1)


def owners(xy: np.ndarray, width: int, height: int, tile: int = 16) -> np.ndarray:
    """The nearest point of each pixel centre, ties to the lower row. A tile compares the points only that are near enough to its centre to be nearest anywhere in it."""
    seeds = np.minimum(np.maximum(xy * [width, height], 0), [width - 1e-3, height - 1e-3])
    out = np.empty((height, width), np.int64)
    for y0 in range(0, height, tile):
        for x0 in range(0, width, tile):
            y, x = np.arange(y0, min(y0 + tile, height)) + 0.5, np.arange(x0, min(x0 + tile, width)) + 0.5
            from_centre = np.hypot(seeds[:, 0] - x.mean(), seeds[:, 1] - y.mean())
            near = np.flatnonzero(from_centre <= from_centre.min() + np.hypot(np.ptp(x), np.ptp(y)) + 1e-9)
            d = (x[None, :, None] - seeds[near, 0]) ** 2 + (y[:, None, None] - seeds[near, 1]) ** 2
            out[y0 : y0 + tile, x0 : x0 + tile] = near[d.argmin(axis=2)]
    return out.ravel()


def lloyd(xy: np.ndarray, density: np.ndarray, width: int, height: int, steps: int) -> np.ndarray:
    p = np.arange(width * height)
    for _ in range(steps):
        own, n = owners(xy, width, height), len(xy)
        m = np.bincount(own, density, n)
        some = m > 1e-8
        safe = np.where(some, m, 1)
        x = np.bincount(own, density * (p % width + 0.5), n) / safe / width
        y = np.bincount(own, density * (p // width + 0.5), n) / safe / height
        xy = np.where(some[:, None], np.clip(np.stack([x, y], 1), 0, 1), xy)
    return xy


def split_cell(pixels: np.ndarray, density: np.ndarray, width: int) -> tuple[int, int]:
    """The pixels for the two halves of a cell, either side of its centre along its long axis."""
    x, y = pixels % width + 0.5, pixels // width + 0.5
    w = density[pixels] if density[pixels].sum() > 1e-12 else np.ones(len(pixels))
    w = w / w.sum()
    mx, my = (w * x).sum(), (w * y).sum()
    vx, vy = max((w * x * x).sum() - mx * mx, 0.0), max((w * y * y).sum() - my * my, 0.0)
    cov = (w * x * y).sum() - mx * my
    eigen = 0.5 * (vx + vy) + np.hypot(0.5 * (vx - vy), cov)
    norm, reach = np.hypot(cov, eigen - vx), max(np.sqrt(eigen), 0.5)
    dx, dy = (reach * cov / norm, reach * (eigen - vx) / norm) if norm > 1e-30 else (reach, 0.0)

    def nearest(tx: float, ty: float, forbid: int) -> int:
        d = (x - tx) ** 2 + (y - ty) ** 2
        d = np.where(pixels == forbid, np.inf, d)
        return int(pixels[np.lexsort((pixels, d))[0]])

    parent = nearest(mx - dx, my - dy, -1)
    return parent, nearest(mx + dx, my + dy, parent)


def count_target(state: State, n: int, o: Options) -> int:
    state.smoothed = float(n) if not state.frame else o.ema * state.smoothed + (1 - o.ema) * n
    return max(1, int(np.rint(state.smoothed)))


def limited_target(n: int, target: int, o: Options) -> int:
    low, high = int(n * (1 - o.max_count_rate)), max(n + 1, int(np.ceil(n * (1 + o.max_count_rate))))
    return max(1, min(max(target, low), high))


def blend_history(state: State, values: np.ndarray, o: Options) -> np.ndarray:
    """Attributes (log-covariance and colour) mixed with those that a track's slot had before; births keep theirs."""
    out = values.astype(np.float64).copy()
    for i, (slot, had) in enumerate(zip(state.slots, state.old)):
        if had and str(slot) in state.history:
            out[i] = o.blend * np.array(state.history[str(slot)]) + (1 - o.blend) * out[i]
    out[:, 3:6] = np.clip(out[:, 3:6], 0, 1)
    state.history = {str(s): v.tolist() for s, v in zip(state.slots, out)}
    return out


def looked_up(maps: np.ndarray, xy: np.ndarray, width: int, height: int) -> np.ndarray:
    """The values of [layers, height * width] maps at normalised points, between pixel centres; nothing lies outside."""
    layers = np.pad(maps.reshape(-1, height, width), ((0, 0), (1, 1), (1, 1)))
    x, y = xy[:, 0] * width + 0.5, xy[:, 1] * height + 0.5
    x0, y0 = np.clip(np.floor(x), 0, width).astype(int), np.clip(np.floor(y), 0, height).astype(int)
    fx, fy = x - x0, y - y0
    return (layers[:, y0, x0] * (1 - fx) * (1 - fy) + layers[:, y0, x0 + 1] * fx * (1 - fy) + layers[:, y0 + 1, x0] * (1 - fx) * fy + layers[:, y0 + 1, x0 + 1] * fx * fy).T


def push(state: State, density: np.ndarray, width: int, height: int, n: int, o: Options, capacity: int | None = None, maps: np.ndarray | None = None) -> tuple[pd.DataFrame, dict]:
    """One frame: the tracks it shows (with ``maps``, and their attributes, blended with those of the frames before), its statistics, and the state repaired for the next frame (in place)."""
    capacity = capacity or 2 * n + 64
    first = not state.frame
    target = count_target(state, n, o)
    if first:
        xy = hilbert_seeds(density, width, height, n)
        state.ids, state.slots = list(range(n)), list(range(n))
        state.strikes, state.old = [0] * n, [False] * n
        state.free = list(range(capacity - 1, n - 1, -1))
        state.next_id = n
        xy = lloyd(lloyd(xy, density, width, height, o.lloyd), density, width, height, o.lloyd)
    else:
        xy = lloyd(np.stack([state.x, state.y], 1), density, width, height, o.lloyd)
    count = len(xy)
    own = owners(xy, width, height)
    mass = np.bincount(own, density, count)
    weight = mass * (count / max(mass.sum(), 1e-8))
    shown = pd.DataFrame({"track_id": state.ids, "slot": state.slots, "x": xy[:, 0], "y": xy[:, 1], "mass": mass, "weight": weight})
    if maps is not None:
        shown[list(ATTRIBUTES)] = blend_history(state, looked_up(maps, xy, width, height), o)
    survivors = state.kept

    limit = limited_target(count, target, o)
    rel = mass * (limit / max(mass.sum(), 1e-12))
    hot, cold = rel > 1 + o.tau_hot, rel < 1 - o.tau_cold
    strikes = np.where(hot | cold, np.minimum(np.array(state.strikes), o.patience - 1) + 1, 0)
    ripe = strikes >= o.patience
    delta = count - limit
    cap = max(1, int(o.churn_fraction * count)) if o.churn_fraction > 0 else 0
    budget = min(cap, max(int((ripe & hot).sum()), int((ripe & cold).sum())), max(0, (count - abs(delta)) // 2))
    kill_order = np.lexsort((np.arange(count), rel, ~(ripe & cold)))
    kill_rank = np.empty(count, np.int64)
    kill_rank[kill_order] = np.arange(count)
    kills, splits = max(0, delta) + budget, max(0, -delta) + budget
    n_pixels = np.bincount(own, minlength=count)
    fit = np.flatnonzero((kill_rank >= kills) & (n_pixels >= 2)) if splits else np.zeros(0, np.int64)
    fit = fit[np.lexsort((fit, -mass[fit]))]
    born = min(splits, len(fit))
    killed = max(0, delta + born)
    shortfall = max(0, limit - (count - killed + born))
    children, xy = [], xy.copy()
    for i in fit[:born]:
        parent, child = split_cell(np.flatnonzero(own == i), density, width)
        xy[i] = (parent % width + 0.5) / width, (parent // width + 0.5) / height
        strikes[i] = 0
        children.append(((child % width + 0.5) / width, (child // width + 0.5) / height))
    state.free += [state.slots[i] for i in kill_order[:killed]]
    keep = np.flatnonzero(kill_rank >= killed)
    new_slots = [state.free.pop() for _ in range(born)]
    state.ids = [state.ids[i] for i in keep] + list(range(state.next_id, state.next_id + born))
    state.slots = [state.slots[i] for i in keep] + new_slots
    state.strikes = [int(strikes[i]) for i in keep] + [0] * born
    state.old = [True] * len(keep) + [False] * born
    state.x = [float(xy[i, 0]) for i in keep] + [c[0] for c in children]
    state.y = [float(xy[i, 1]) for i in keep] + [c[1] for c in children]
    state.next_id += born
    stats = {"frame": state.frame, "n_requested": n, "n_target": target, "n_target_limited": limit, "n_tracks": count, "survivors": survivors, "kills_for_next": killed, "births_for_next": born, "shortfall_for_next": shortfall, "retained_fraction": survivors / count if not first else 0.0}
    state.kept = len(keep)
    state.frame += 1
    return shown, stats


#: Attributes of a track, in the order of the layers of a frame's maps.
ATTRIBUTES = ("lc_xx", "lc_xy", "lc_yy", "r", "g", "b")
TRACK_SCHEMA = "stream_id long, frame long, track_id long, slot int, x double, y double, mass double, weight double, n_target long, n_target_limited long, survivors long, kills_for_next long, births_for_next long, shortfall_for_next long, retained_fraction double"


def _frames(held: State, frames: pd.DataFrame, stream: int, width: int, height: int, o: Options) -> Iterator[pd.DataFrame]:
    mapped = "maps" in frames.columns
    names = [c.split()[0] for c in _schema(mapped).split(", ")]
    for f in frames.sort_values("frame").itertuples():
        if held.closed:
            raise ValueError(f"stream {stream} is closed: frame {f.frame}")
        if getattr(f, "close", None):
            held.closed = True
            continue
        density = np.zeros(width * height)
        density[: len(f.density)] = np.nan_to_num(np.asarray(f.density, float), nan=0.0, posinf=0.0, neginf=0.0)
        maps = np.asarray(f.maps, float) if mapped else None
        shown, stats = push(held, np.maximum(density, 0), width, height, int(f.n), o, maps=maps)
        stats.pop("frame"), stats.pop("n_requested"), stats.pop("n_tracks")
        yield shown.assign(stream_id=stream, frame=f.frame, **stats)[names]


def _schema(mapped: bool) -> str:
    return TRACK_SCHEMA + (", " + ", ".join(f"{c} double" for c in ATTRIBUTES) if mapped else "")


def track_frames(frames: DataFrame, width: int, height: int, options: Options | None = None) -> DataFrame:
    """Tracks of every frame of ``frames`` (stream_id, frame, n, density: array), a batch or a stream.

    With a column maps (the layers of ``ATTRIBUTES``, one after the other) tracks
    have attributes, looked up at their points and blended with those their slots
    had before. With a column close, a row where it is true ends its stream; a later
    frame is an error. Frames of a stream are pushed in order; in a stream those of
    one micro-batch are sorted, and later batches must hold later frames. State is
    kept for each stream and a failed batch starts again from the last committed
    state.
    """
    o, mapped = options or Options(), "maps" in frames.columns
    if not frames.isStreaming:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            found = list(_frames(State(), pdf, int(pdf["stream_id"].iloc[0]), width, height, o))
            return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c.split()[0]: [] for c in _schema(mapped).split(", ")})

        return frames.groupBy("stream_id").applyInPandas(whole, _schema(mapped))

    def step(key, batches, held):
        state = State.loads(held.get[0]) if held.exists else State()
        yield from _frames(state, pd.concat(list(batches)), int(key[0]), width, height, o)
        held.update((state.dumps(),))

    return frames.groupBy("stream_id").applyInPandasWithState(step, _schema(mapped), "state string", "append", "NoTimeout")


def smooth_counts(frames: DataFrame, options: Options | None = None, most: int = 1 << 24) -> DataFrame:
    """(stream_id, frame, n, smoothed, n_target): the count recurrence alone.

    A frame's step is a map s -> a s + b, and such maps compose: frames are numbered and
    folded by blocks, so a stream of any length is spread over tasks. ``most`` frames of a
    stream are expected, which sets how deep the blocks go.
    """
    keep = F.lit((options or Options()).ema)
    placed = scratch(ranked(frames.select("stream_id", "frame", F.col("n").cast("long").alias("n")), ["stream_id"], ["frame"], "__i"), "frames")
    first = F.col("__i") == 0
    steps = placed.withColumns({"a": F.when(first, 0.0).otherwise(keep), "b": F.when(first, F.lit(1.0)).otherwise(1 - keep) * F.col("n")})
    found = recurrence(steps, ["stream_id"], "__i", most, "smoothed")
    return found.select("stream_id", "frame", "n", "smoothed", F.greatest(F.lit(1), F.rint("smoothed").cast("long")).alias("n_target"))
