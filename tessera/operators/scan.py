"""The production scan: every linear part of a pose grid against every translation of a field, by Fourier transforms.

A task row is one shard of poses of one sample, so a sample is spread over as many tasks as it has shards.  What the
shards of a sample share, the spectrum of its smoothed target, is computed once and stored.  Each shard
returns the best few local maxima of each pose (a bounded heap, whatever the size of the map); ``separated`` then
keeps the best peaks of a sample that differ in angle or landing, in rounds over cells of pose space.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators.candidates import STRETCHES
from tessera.plans.stages import ensure_checkpoint_dir

# Ends of the grid, empty cells before a template's first point, separation of peaks.
ANGLES, SCALES, MARGIN = (-35.0, 35.0), (0.85, 1.13), 2
SEPARATION = (3.0, 20.0)
#: Points times linear parts that are moved at once: their arrays stay in a core's cache, however many points a sample has.
BLOCK = 1 << 15


def even_axis(ends: tuple[float, float], step: float) -> np.ndarray:
    """From one end to the other, both exact, in steps of at most ``step`` (O203)."""
    if not (math.isfinite(step) and step > 0):
        raise ValueError(f"step {step!r} is not a positive number")
    return np.linspace(*ends, math.ceil((ends[1] - ends[0]) / step - 1e-9) + 1)


def grid(spark: SparkSession, angles=None, scales=None, stretches=STRETCHES, shard: int = 512) -> DataFrame:
    """pose_id in the order angle, scale, stretch; shard; the parameters and the linear part scale * rotation * stretch.

    With nothing given, the 141 * 29 * 17 = 69,513 poses of production."""
    axes = {"angle": even_axis(ANGLES, 0.5) if angles is None else angles, "scale": even_axis(SCALES, 0.01) if scales is None else scales}
    kinds = F.array(*[F.struct(F.lit(float(k)).alias("stretch"), F.lit(float(p)).alias("direction")) for k, p in stretches])
    listed = {n: F.array(*[F.lit(float(v)) for v in values]) for n, values in axes.items()}
    rows = spark.range(1).select(F.posexplode(listed["angle"]).alias("_i", "angle")).select("*", F.posexplode(listed["scale"]).alias("_j", "scale")).select("*", F.posexplode(kinds).alias("_k", "_s"))
    n_scale, n_kind = len(axes["scale"]), len(stretches)
    pose_id = ((F.col("_i") * n_scale + F.col("_j")) * n_kind + F.col("_k")).cast("long")
    t, p, k = F.radians("angle"), F.radians("_s.direction"), F.col("_s.stretch") - 1
    xx, xy, yy = 1 + k * F.cos(p) * F.cos(p), k * F.cos(p) * F.sin(p), 1 + k * F.sin(p) * F.sin(p)
    s, cos, sin = F.col("scale"), F.cos(t), F.sin(t)
    linear = {"a": s * (cos * xx - sin * xy), "b": s * (cos * xy - sin * yy), "c": s * (sin * xx + cos * xy), "d": s * (sin * xy + cos * yy)}
    return rows.select(pose_id.alias("pose_id"), F.floor(pose_id / shard).cast("int").alias("shard"), "angle", "scale", "_s.stretch", "_s.direction", *[v.alias(n) for n, v in linear.items()])


def fast_size(n: int) -> int:
    """The smallest number from ``n`` on without prime factors over 5."""
    found = 1 << max(0, n - 1).bit_length()
    for fives in range(10):
        for threes in range(14):
            odd = 5**fives * 3**threes
            if odd < found:
                found = min(found, odd << max(0, -(-n // odd) - 1).bit_length())
    return max(1, found)


def scatter(points: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear maps (sets, rows, columns) of point sets (sets, points, 2) in cells; all corners must lie inside."""
    return spread(points[..., 0], points[..., 1], shape)


def spread(x: np.ndarray, y: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """``scatter`` of columns ``x`` and rows ``y`` (sets, points).  The four weights of a point are sums of 1, x, y and xy of its
    place in the cell, so a cell's four sums give what it leaves at its corners."""
    col, row = np.floor(x), np.floor(y)
    x, y = x - col, y - row
    row *= shape[1]
    row += col
    row += (np.arange(len(x)) * (shape[0] * shape[1]))[:, None]
    cell = row.astype(np.intp).ravel()
    one, sx, sy, sxy = (np.bincount(cell, w, len(x) * shape[0] * shape[1]).reshape(len(x), *shape) for w in (None, x.ravel(), y.ravel(), (x * y).ravel()))
    out = one - sx - sy + sxy
    out[:, :, 1:] += (sx - sxy)[:, :, :-1]
    out[:, 1:] += (sy - sxy)[:, :-1]
    out[:, 1:, 1:] += sxy[:, :-1, :-1]
    return out


def outer(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull: a linear part has its least and largest coordinates there."""
    order = points[np.lexsort((points[:, 1], points[:, 0]))]
    first = np.flatnonzero(np.r_[True, np.diff(order[:, 0]) != 0])
    last = np.r_[first[1:], len(order)] - 1
    found = []
    for line in (order[first], order[last][::-1]):  # lowest of each x from the left, highest from the right
        chain = []
        for x, y in line.tolist():
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (y - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (x - chain[-2][0]):
                chain.pop()
            chain.append((x, y))
        found += chain
    return np.unique(found, axis=0)


@dataclasses.dataclass(frozen=True)
class Frame:
    """Sizes of one sample's maps: the canvas, the common template of all poses, and the transform."""

    low: tuple[float, float]
    size: tuple[float, float]
    template: tuple[int, int]
    cell: float
    sigma: float

    @property
    def spread(self) -> float:
        return self.sigma * math.sqrt(2) / self.cell

    @property
    def reach(self) -> int:
        return math.ceil(4 * self.spread)

    @property
    def canvas(self) -> tuple[int, int]:
        return math.ceil(self.size[1] / self.cell) + 2, math.ceil(self.size[0] / self.cell) + 2

    @property
    def fft(self) -> tuple[int, int]:
        return tuple(fast_size(c + t + 2 * self.reach) for c, t in zip(self.canvas, self.template))

    def spectrum(self, target: np.ndarray) -> np.ndarray:
        image = scatter(((target - self.low) / self.cell)[None], self.canvas)[0]
        d = np.arange(-self.reach, self.reach + 1)
        bell, kernel = np.exp(-(d**2) / (2 * self.spread**2)), np.zeros(self.fft)
        kernel[np.ix_(d % self.fft[0], d % self.fft[1])] = bell[:, None] * bell
        return np.fft.rfft2(image, self.fft) * np.fft.rfft2(kernel)

    def templates(self, source: np.ndarray, linear: np.ndarray, origin: np.ndarray) -> np.ndarray:
        """Maps of the moved source, BLOCK points at a time."""
        maps, at_once = np.zeros((len(linear), *self.template)), max(1, BLOCK // len(source))
        for p in range(0, len(linear), at_once):
            part, start = linear[p : p + at_once] / self.cell, origin[p : p + at_once]
            for n in range(0, len(source), BLOCK):
                x, y = (part[:, i] @ source[n : n + BLOCK].T + start[:, i, None] for i in (0, 1))
                maps[p : p + at_once] += spread(x, y, self.template)
        return maps

    def peaks(self, spectrum: np.ndarray, source: np.ndarray, linear: np.ndarray, most: int, edge: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Index, score and translation of the ``most`` best local maxima of each of a few linear parts.  ``edge``: the source's
        ``outer`` points, if known.

        A shift counts if the centre of the moved source lies on the canvas; a maximum is beaten by none of
        its eight neighbours that count.
        """
        lowest = np.einsum("pij,nj->pni", linear, outer(source) if edge is None else edge).min(1)
        origin = MARGIN - np.floor(lowest / self.cell)
        # transforms skip what is known to be empty (rows below the template) or never looked at (rows off the canvas)
        maps = np.fft.fft(np.fft.rfft(self.templates(source, linear, origin), self.fft[1], 2), self.fft[0], 1)
        np.conjugate(maps, maps)
        maps *= spectrum
        centre = linear @ source.mean(0) / self.cell + origin  # of the template, in cells
        low, high = np.ceil(-centre.max(0)).astype(int) - 1, np.ceil(np.array(self.size) / self.cell - centre.min(0)).astype(int) + 1
        cols, rows = (np.arange(a, b) for a, b in zip(low, high))
        half = np.fft.ifft(maps, axis=1)[:, rows % self.fft[0]]
        score = np.fft.irfft(half, self.fft[1], 2)[:, :, cols % self.fft[1]]
        for axis, at in ((1, rows), (0, cols)):
            place = self.cell * (centre[:, axis, None] + at)
            off = (place < 0) | (place >= self.size[axis])
            score[np.broadcast_to(off[:, :, None] if axis else off[:, None], score.shape)] = -np.inf
        around = score
        for axis in (1, 2):  # the largest of three along rows, then along columns; the window ends off the canvas
            around = np.maximum.reduce([around, np.roll(around, 1, axis), np.roll(around, -1, axis)])
        pose, row, col = np.nonzero((score == around) & (score > 1e-9))
        value = score[pose, row, col]
        order = np.lexsort((cols[col], rows[row], -np.round(value, 9), pose))
        pose, row, col, value = pose[order], row[order], col[order], value[order]
        place = np.arange(len(pose)) - np.searchsorted(pose, pose)
        kept = place < most
        pose, row, col = pose[kept], row[kept], col[kept]
        shift = np.stack([cols[col], rows[row]], 1) + origin[pose]
        return pose, value[kept], self.cell * shift + np.array(self.low)


def frame_of(source: np.ndarray, target: np.ndarray, linear: np.ndarray, cell: float, sigma: float) -> Frame:
    """The common sizes for all poses of a sample.  Of ``source`` the ``outer`` points are enough."""
    widest = np.zeros(2)
    for at in range(0, len(linear), 2048):
        moved = (linear[at : at + 2048].reshape(-1, 2) @ source.T).reshape(-1, 2, len(source))
        widest = np.maximum(widest, np.ptp(moved, axis=2).max(0))
    template = tuple(int(w / cell) + MARGIN + 4 for w in widest[::-1])
    return Frame(tuple(target.min(0)), tuple(np.ptp(target, axis=0)), template, cell, sigma)


_SPECTRA = "sample_id string, low array<double>, size array<double>, template array<int>, source array<double>, edge array<double>, spectrum binary"
_PEAKS = "sample_id string, pose_id long, place int, score double, tx double, ty double"


def spectra(left: DataFrame, right: DataFrame, poses: DataFrame, cell: float, sigma: float) -> DataFrame:
    """One row a sample: the sizes, the source points and the spectrum of the target.  ``poses`` is a grid (a parameter)."""
    linear = np.array(poses.orderBy("pose_id").select("a", "b", "c", "d").collect()).reshape(-1, 2, 2)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            src, dst = (x.sort_values("idx")[["x", "y"]].to_numpy(float) for x in (a, b))
            edge = outer(src)
            frame = frame_of(edge, dst, linear, cell, sigma)
            rows.append((a.sample_id.iloc[0], frame.low, frame.size, frame.template, src.ravel(), edge.ravel(), frame.spectrum(dst).tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _SPECTRA.split(", ")])

    return left.select("sample_id", "idx", "x", "y").groupBy("sample_id").cogroup(right.select("sample_id", "idx", "x", "y").groupBy("sample_id")).applyInPandas(run, _SPECTRA)


def peaks(left: DataFrame, right: DataFrame, poses: DataFrame, cell: float = 2.0, sigma: float = 2.5, most: int = 4, map_bytes: int = 64 << 20) -> DataFrame:
    """The ``most`` best local maxima of each pose of each sample: sample_id, pose_id, place, score, tx, ty (O102, O103, O104).

    ``left``, ``right``: sample_id, idx, x, y.  ``poses`` (``grid``) gives the shards.  A task holds ``map_bytes`` of maps at
    a time, whatever the shard.
    """
    spark = left.sparkSession
    ensure_checkpoint_dir(spark)
    shared = spectra(left, right, poses, cell, sigma).checkpoint()
    shards = poses.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("pose_id", "a", "b", "c", "d"))).alias("poses"))
    tasks = shared.crossJoin(F.broadcast(shards))  # a parameter grid: as many rows as shards
    many = shared.count() * shards.count()

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in part.itertuples():
            frame = Frame(tuple(row.low), tuple(row.size), tuple(map(int, row.template)), cell, sigma)
            spectrum = np.frombuffer(row.spectrum, complex).reshape(frame.fft[0], frame.fft[1] // 2 + 1)
            source, edge = (np.asarray(v, float).reshape(-1, 2) for v in (row.source, row.edge))
            ids = np.array([p["pose_id"] for p in row.poses])
            linear = np.array([[p[c] for c in "abcd"] for p in row.poses], float).reshape(-1, 2, 2)
            step = max(1, map_bytes // (48 * frame.fft[0] * frame.fft[1]))
            for at in range(0, len(ids), step):
                pose, score, shift = frame.peaks(spectrum, source, linear[at : at + step], most, edge)
                place = np.arange(len(pose)) - np.searchsorted(pose, pose) + 1
                out.append(pd.DataFrame({"sample_id": key[0], "pose_id": ids[at + pose], "place": place, "score": score, "tx": shift[:, 0], "ty": shift[:, 1]}))
        return pd.concat(out)

    # by number: rows are few and small, work is not
    spread = tasks.repartition(max(1, min(many, 8 * spark.sparkContext.defaultParallelism)), "sample_id", "shard")
    return spread.groupBy("sample_id", "shard").applyInPandas(run, _PEAKS)


def placed(found: DataFrame, poses: DataFrame, offsets: DataFrame) -> DataFrame:
    """``found`` with the parameters of its pose and the landing of the probe point.  ``offsets``: sample_id, ox, oy."""
    known = found.join(F.broadcast(poses.drop("shard")), "pose_id").join(offsets, "sample_id")
    u, v = F.lit(g.PROBE[0]) - F.col("ox"), F.lit(g.PROBE[1]) - F.col("oy")
    return known.withColumns({"land_x": F.col("a") * u + F.col("b") * v + F.col("tx"), "land_y": F.col("c") * u + F.col("d") * v + F.col("ty")}).drop("ox", "oy")


#: Shares of a sample's rows at which its slices end, best scores first; no slice is more than a sixteenth.
_SHARES = [*(4.0**-j for j in range(8, 2, -1)), *(i / 16 for i in range(1, 17))]


def separated(rows: DataFrame, k: int, order: list[str], separation: tuple[float, float] = SEPARATION) -> DataFrame:
    """Greedy separation: by descending ``score``, ties by ``order`` ascending, a row is skipped if a kept one of its sample is
    within both tolerances; the first ``k`` kept, with their place (O105).

    ``rows``: sample_id, score, angle, land_x, land_y and ``order``, which must be unique in a sample.  What is kept among
    the best rows does not depend on the others, so a sample is taken slice by slice of falling score, until
    ``k`` are kept; a task holds one slice and the rows kept so far.  A column ``place`` of ``rows`` is replaced.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.drop("place").checkpoint()
    cuts = F.percentile_approx("score", F.array(*[F.lit(1 - f) for f in _SHARES[:-1]]), F.lit(10_000)).alias("_cuts")
    known = rows.groupBy("sample_id").agg(F.count("*").alias("_n"), cuts)
    # the first slice: the smallest share that holds a few rows for each that is wanted
    first = sum(F.when(F.lit(f) * F.col("_n") < 64 * k, 1).otherwise(0) for f in _SHARES[:-1])
    todo = known.select("sample_id", "_cuts", first.alias("_at"), F.lit(float("inf")).alias("_below")).checkpoint()
    columns = [*rows.columns, "place"]
    schema = ", ".join(f"{n} {t}" for n, t in [*rows.dtypes, ("place", "int")])

    def run(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        new = new.sort_values(["score", *order], ascending=[False, *[True] * len(order)])
        both = pd.concat([old.sort_values("place"), new], ignore_index=True) if len(old) else new.reset_index(drop=True)
        pose, taken = both[["angle", "land_x", "land_y"]].to_numpy(float), list(range(len(old)))
        for i in range(len(old), len(both)):
            if len(taken) == k:
                break
            gap = pose[taken] - pose[i]
            if not ((np.abs(gap[:, 0]) <= separation[0]) & (np.hypot(gap[:, 1], gap[:, 2]) <= separation[1])).any():
                taken.append(i)
        return both.iloc[taken].assign(place=range(1, len(taken) + 1))[columns]

    found, kept = None, rows.sparkSession.createDataFrame([], schema)
    while not todo.isEmpty():
        low = F.coalesce(F.get("_cuts", F.col("_at")), F.lit(float("-inf")))  # the last slice has no cut
        part = rows.join(todo, "sample_id").where((F.col("score") >= low) & (F.col("score") < F.col("_below"))).select(*rows.columns)
        kept = part.groupBy("sample_id").cogroup(kept.groupBy("sample_id")).applyInPandas(run, schema).checkpoint()
        many = kept.groupBy("sample_id").agg(F.count("*").alias("_kept"))
        more = (F.coalesce(F.col("_kept"), F.lit(0)) < k) & (F.col("_at") < len(_SHARES) - 1)
        todo = todo.join(many, "sample_id", "left").where(more).select("sample_id", "_cuts", (F.col("_at") + 1).alias("_at"), low.alias("_below")).checkpoint()
        done = kept.join(todo, "sample_id", "left_anti")
        found, kept = done if found is None else found.unionByName(done), kept.join(todo, "sample_id", "left_semi")
    return kept if found is None else found
