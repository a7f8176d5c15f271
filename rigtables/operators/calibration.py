"""Calibration fits: gathering points, rejecting outliers, linear maps and homographies with RANSAC.

Fits keyed by calibration_id run side by side. Points stay where they are: hypotheses go to them, and only counts and
sums of products come back. Where there are more calibrations than a task can hold the hypotheses of, points and
hypotheses meet in salted groups instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rigtables.durable import kept
from rigtables.functions.geometry import apply_homography, apply_map
from rigtables.operators.selection import SMALL, largest_group, quantiles

HALF = 0.5
#: Groups into which one calibration's points are dealt; points from which hypotheses are drawn; hypotheses (of 80 bytes) that go to every task.
SALTS, POOL, EVERYWHERE = 32, 512, 500_000
FEATURES = ("stage_x", "stage_y", "pixel_x", "pixel_y")


def calibration_points(scan: DataFrame, detections: DataFrame, tags: DataFrame) -> DataFrame:
    """One row for each detected corner of each scan image, with its stage, pixel and physical position.

    Of several detections of the expected tag in an image the first (by detection_no) counts; x is flipped back as
    image_width - 1 - x. physical_x_mm is null where the arena doesn't know the tag.
    """
    first = W.partitionBy("apriltag_id", "image_id").orderBy("detection_no")
    matching = detections.where("detected_id = apriltag_id").withColumn("_r", F.dense_rank().over(first)).where("_r = 1")
    flipped = matching.select("apriltag_id", "image_id", "corner_id", (F.col("image_width") - 1 - F.col("x_px")).alias("pixel_x_px"), F.col("y_px").alias("pixel_y_px"))
    return scan.join(flipped, ["apriltag_id", "image_id"]).join(tags, ["apriltag_id", "corner_id"], "left")


def missing_detections(scan: DataFrame, detections: DataFrame) -> DataFrame:
    """Scan images without a detection of the expected tag."""
    return scan.join(detections.where("detected_id = apriltag_id"), ["apriltag_id", "image_id"], "left_anti")


def match_corners(a: DataFrame, b: DataFrame, least: int = 4) -> DataFrame:
    """Corners (stage_x, stage_y, corner_id, x, y) that both cameras see, at positions with at least `least` of them."""
    keys = ["stage_x", "stage_y", "corner_id"]
    both = a.withColumnsRenamed({"x": "x_a", "y": "y_a"}).join(b.withColumnsRenamed({"x": "x_b", "y": "y_b"}), keys)
    return both.withColumn("n", F.count("*").over(W.partitionBy("stage_x", "stage_y"))).where(F.col("n") >= least).drop("n")


def mad_outlier_filter(points: DataFrame, keys: list[str], x: str = "pixel_x_px", y: str = "pixel_y_px", threshold: float = 3.0, floor: float = 1.0, small: int = SMALL) -> DataFrame:
    """points with distance, limit and kept: a point stays within max(threshold * 1.4826 * MAD, floor) of its group's median.

    MAD is the median deviation of the distances from their median. Medians of groups of over `small` points are selected in passes.
    """
    n = largest_group(points, keys)
    middle = quantiles(points, keys, {"_mx": (F.col(x), HALF), "_my": (F.col(y), HALF)}, small, n)
    away = points.join(middle, keys).withColumn("distance", F.sqrt(F.pow(F.col(x) - F.col("_mx"), F.lit(2.0)) + F.pow(F.col(y) - F.col("_my"), F.lit(2.0))))
    typical = quantiles(away, keys, {"_md": (F.col("distance"), HALF)}, small, n)
    spread = quantiles(away.join(typical, keys), keys, {"_mad": (F.abs(F.col("distance") - F.col("_md")), HALF)}, small, n)
    limit = F.greatest(threshold * 1.4826 * F.col("_mad"), F.lit(float(floor)))
    return away.join(spread, keys).withColumn("limit", limit).withColumn("kept", F.col("distance") <= F.col("limit")).drop("_mx", "_my", "_mad")


def samples_per_tag(before: DataFrame, after: DataFrame) -> DataFrame:
    """(apriltag_id, n_before, n_after) for the tags of either; 0 where a tag is absent."""
    n = [d.groupBy("apriltag_id").agg(F.count("*").alias(c)) for d, c in ((before, "n_before"), (after, "n_after"))]
    return n[0].join(n[1], "apriltag_id", "full").select("apriltag_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_before", "n_after")))


def corner_distances(detections: DataFrame) -> DataFrame:
    """Detections (stage_x, stage_y, camera, image_idx, is_reference, corner_id, x, y) with the distance to the reference's corner.

    Corners that the reference detection of their position and camera lacks are left out.
    """
    keys = ["stage_x", "stage_y", "camera", "corner_id"]
    reference = detections.where("is_reference").groupBy(*keys).agg(F.min(F.struct("image_idx", "x", "y")).alias("_r"))
    seen = detections.where("NOT is_reference").join(reference, keys)
    return seen.withColumn("distance", F.sqrt(F.pow(F.col("x") - F.col("_r.x"), F.lit(2.0)) + F.pow(F.col("y") - F.col("_r.y"), F.lit(2.0)))).drop("_r")


def corner_consensus(detections: DataFrame, noise_px: float = 1.0, small: int = SMALL) -> DataFrame:
    """(stage_x, stage_y, camera, corner_id, x, y, n): the median of detections within noise_px of the reference's corner."""
    keys, near = ["stage_x", "stage_y", "camera", "corner_id"], corner_distances(detections).where(F.col("distance") <= noise_px)
    middle = quantiles(near, keys, {"x": (F.col("x"), HALF), "y": (F.col("y"), HALF)}, small)
    return middle.join(near.groupBy(*keys).agg(F.count("*").alias("n")), keys)


def rejection_stats(detections: DataFrame, noise_px: float = 1.0) -> DataFrame:
    """(camera, n_total, n_rejected, percent_rejected, mean_rejected_px, max_rejected_px)."""
    far = F.when(F.col("distance") > noise_px, F.col("distance"))
    return corner_distances(detections).groupBy("camera").agg(
        F.count("*").alias("n_total"), F.count(far).alias("n_rejected"), (100 * F.count(far) / F.count("*")).alias("percent_rejected"), F.avg(far).alias("mean_rejected_px"), F.max(far).alias("max_rejected_px")
    )


def linear_map_fit(points: DataFrame, key: str = "calibration_id") -> DataFrame:
    """(key, weights array of 10, n): least squares of physical_x and physical_y on stage, pixel and 1.

    Sums of products are all that is gathered of the points; the least-norm answer stands where they don't decide.
    """
    columns = [*FEATURES, "_one"]
    names = [(i, j) for i in range(5) for j in range(i, 5)]
    df = points.withColumn("_one", F.lit(1.0))
    sums = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}{j}") for i, j in names]
    sums += [F.sum(F.col(columns[i]) * F.col(t)).alias(f"{t}{i}") for t in ("physical_x", "physical_y") for i in range(5)]

    def solve(batches):
        for pdf in batches:
            weights = []
            for row in pdf.to_dict("records"):
                a = np.zeros((5, 5))
                for i, j in names:
                    a[i, j] = a[j, i] = row[f"s{i}{j}"]
                scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
                b = np.array([[row[f"{t}{i}"] for i in range(5)] for t in ("physical_x", "physical_y")])
                w = np.linalg.lstsq(a / np.outer(scale, scale), (b / scale).T, rcond=1e-13)[0].T / scale
                weights.append(w.ravel().tolist())
            yield pd.DataFrame({key: pdf[key], "weights": weights, "n": pdf["n"]})

    kind = points.schema[key].dataType.simpleString()
    return df.groupBy(key).agg(F.count("*").alias("n"), *sums).mapInPandas(solve, f"{key} {kind}, weights array<double>, n long")


def residuals(points: DataFrame, fit: DataFrame, key: str = "calibration_id") -> DataFrame:
    """points with residual_x, residual_y (predicted less measured) and residual, their norm."""
    joined = points.join(fit.select(key, "weights"), key)
    x, y = apply_map(F.col("weights"), *(F.col(c) for c in FEATURES))
    joined = joined.withColumns({"residual_x": x - F.col("physical_x"), "residual_y": y - F.col("physical_y")}).drop("weights")
    return joined.withColumn("residual", F.hypot("residual_x", "residual_y"))


def fit_metrics(points: DataFrame, key: str = "calibration_id") -> DataFrame:
    """Counts, RMSEs, largest residual and R2 over the inliers of points with residuals and `inlier`."""
    inside = lambda c: F.when(F.col("inlier"), F.col(c))
    square = lambda c: F.when(F.col("inlier"), F.col(c) * F.col(c))
    r2 = lambda a: 1 - F.sum(square(f"residual_{a}")) / F.nullif(F.var_pop(inside(f"physical_{a}")) * F.count_if("inlier"), F.lit(0.0))
    return points.groupBy(key).agg(
        F.count("*").alias("n_total"),
        F.count_if("inlier").alias("n_inliers"),
        F.count_if(~F.col("inlier")).alias("n_outliers"),
        (100 * F.count_if(~F.col("inlier")) / F.count("*")).alias("percent_outliers"),
        F.sqrt(F.avg(square("residual_x"))).alias("rmse_x"),
        F.sqrt(F.avg(square("residual_y"))).alias("rmse_y"),
        F.sqrt(F.avg(square("residual"))).alias("rmse"),
        F.max(inside("residual")).alias("max_residual"),
        r2("x").alias("r2_x"),
        r2("y").alias("r2_y"),
    )


def _pool(points: DataFrame, key: str, row: str, size: int) -> DataFrame:
    """At most `size` points of each calibration, those of least hash; two steps, so that none is gathered whole."""
    hashed = points.withColumn("_h", F.xxhash64(row))
    dealt = W.partitionBy(key, F.pmod("_h", F.lit(SALTS))).orderBy("_h", row)
    few = hashed.withColumn("_r", F.row_number().over(dealt)).where(F.col("_r") <= size)
    return few.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("_h", row))).where(F.col("_r") <= size)


def _counted(points: DataFrame, models: DataFrame, key: str, row: str, judge) -> DataFrame:
    """(key, axis, trial) of the best model; judge(points, models) gives errors [model, point] by axis.

    Up to EVERYWHERE models are sent to all tasks and counted over the points where these lie; beyond, both
    meet in groups of (key, salt).
    """
    kind = points.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, axis int, trial int, inliers long, sse double"
    none = pd.DataFrame({key: [], "axis": [], "trial": [], "inliers": [], "sse": []})

    def count(pts: pd.DataFrame, trial: np.ndarray, w: np.ndarray):
        for axis, limit, square in judge(pts, w):
            total, sse = np.zeros(len(trial), np.int64), np.zeros(len(trial))
            for part in square:
                inside = part <= limit**2
                total += inside.sum(axis=1)
                sse += np.where(inside, part, 0).sum(axis=1)
            yield axis, total, sse

    if models.count() <= EVERYWHERE:
        found: dict = {}
        for r in models.select(key, "trial", "w").toLocalIterator():
            found.setdefault(r[0], []).append((r[1], r[2]))
        sent = points.sparkSession.sparkContext.broadcast({k: (np.array([t for t, _ in x], np.int32), np.array([w for _, w in x])) for k, x in found.items()})

        def run(batches):
            sums: dict = {}
            for pdf in batches:
                for name, pts in pdf.groupby(key):
                    if name not in sent.value:
                        continue
                    trial, w = sent.value[name]
                    for axis, total, sse in count(pts, trial, w):
                        have = sums.get((name, axis))
                        sums[name, axis] = (total, sse) if have is None else (have[0] + total, have[1] + sse)
            for (name, axis), (total, sse) in sums.items():
                yield pd.DataFrame({key: name, "axis": axis, "trial": sent.value[name][0], "inliers": total, "sse": sse})

        counted = points.mapInPandas(run, schema)
    else:
        salted = points.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int"))
        spread = models.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))

        def meet(pts: pd.DataFrame, mods: pd.DataFrame) -> pd.DataFrame:
            if not len(pts) or not len(mods):
                return none
            trial = mods["trial"].to_numpy()
            return pd.concat([pd.DataFrame({key: mods[key].iloc[0], "axis": axis, "trial": trial, "inliers": total, "sse": sse}) for axis, total, sse in count(pts, trial, np.stack(mods["w"].to_numpy()))])

        counted = salted.groupBy(key, "_salt").cogroup(spread.groupBy(key, "_salt")).applyInPandas(meet, schema)
    total = counted.groupBy(key, "axis", "trial").agg(F.sum("inliers").alias("inliers"), F.sum("sse").alias("sse"))
    best = F.max_by("trial", F.struct("inliers", F.negative("sse"), F.negative("trial")))
    return total.groupBy(key, "axis").agg(best.alias("trial"))


def _pieces(n: int, size: int = 4096):
    return ((i, min(i + size, n)) for i in range(0, n, size))


def ransac_linear_fit(points: DataFrame, row: str, threshold: float = 0.5, trials: int = 1000, seed: int = 42, key: str = "calibration_id") -> tuple[DataFrame, DataFrame]:
    """(fit, points with residuals and inlier): one RANSAC for each axis, inliers pass both, least squares over them.

    `row` names a unique key. Each trial solves five points of the pool (at most POOL of each calibration, of
    least hash of the key), drawn by a generator seeded by `seed`; its model is counted over all points. Most
    inliers win, then the smaller sum of squares, then the earlier trial.
    """
    kind = points.schema[key].dataType.simpleString()

    def draw(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("_r")
        x = np.column_stack([pool[list(FEATURES)].to_numpy(float), np.ones(len(pool))])
        y = pool[["physical_x", "physical_y"]].to_numpy(float)
        if len(pool) < 5:
            return pd.DataFrame({key: [], "trial": [], "w": []})
        rng = np.random.default_rng(seed)
        picks = np.stack([rng.choice(len(pool), 5, replace=False) for _ in range(trials)])
        w = np.stack([np.linalg.lstsq(x[p], y[p], rcond=None)[0].T.ravel() for p in picks])
        return pd.DataFrame({key: pool[key].iloc[0], "trial": np.arange(trials, dtype=np.int32), "w": w.tolist()})

    models = kept(_pool(points, key, row, POOL).groupBy(key).applyInPandas(draw, f"{key} {kind}, trial int, w array<double>"))

    def judge(pts: pd.DataFrame, w: np.ndarray):
        x = np.column_stack([pts[list(FEATURES)].to_numpy(float), np.ones(len(pts))])
        for axis, target in enumerate(("physical_x", "physical_y")):
            y = pts[target].to_numpy(float)
            yield axis, threshold, ((w[:, 5 * axis : 5 * axis + 5] @ x[a:b].T - y[a:b]) ** 2 for a, b in _pieces(len(y)))

    best = _counted(points, models, key, row, judge)
    chosen = best.join(models, [key, "trial"]).groupBy(key).agg(F.min(F.when(F.col("axis") == 0, F.slice("w", 1, 5))).alias("_x"), F.min(F.when(F.col("axis") == 1, F.slice("w", 6, 5))).alias("_y"))
    rough = residuals(points, chosen.select(key, F.concat("_x", "_y").alias("weights")), key)
    inlier = (F.abs(F.col("residual_x")) <= threshold) & (F.abs(F.col("residual_y")) <= threshold)
    marked = rough.withColumn("inlier", inlier).drop("residual_x", "residual_y", "residual")
    fit = linear_map_fit(marked.where("inlier"), key)
    return fit, residuals(marked, fit, key)


def _dlt(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Two rows for each match (x, y) -> (u, v)."""
    o, z = np.ones_like(x), np.zeros_like(x)
    return np.concatenate([np.column_stack([-x, -y, -o, z, z, z, u * x, u * y, u]), np.column_stack([z, z, z, -x, -y, -o, v * x, v * y, v])])


def _scaled(mean: np.ndarray, size: float) -> np.ndarray:
    s = np.sqrt(2) / size if size > 0 else 1.0
    return np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1.0]])


def homography_fit(matches: DataFrame, row: str, threshold: float = 3.0, trials: int = 1000, seed: int = 42, key: str = "calibration_id") -> tuple[DataFrame, DataFrame]:
    """(fit (key, h array of 9, n_inliers), matches with error_px and inlier) of x_a, y_a -> x_b, y_b.

    The scheme of ransac_linear_fit() with four matches a trial; the refit is the normalised direct linear
    transformation over the inliers, from sums of products.
    """
    kind = matches.schema[key].dataType.simpleString()
    names = ["x_a", "y_a", "x_b", "y_b"]

    def draw(pool: pd.DataFrame) -> pd.DataFrame:
        p = pool.sort_values("_r")[names].to_numpy(float)
        if len(p) < 4:
            return pd.DataFrame({key: [], "trial": [], "w": []})
        ta, tb = (_scaled(p[:, c].mean(axis=0), float(np.hypot(*(p[:, c] - p[:, c].mean(axis=0)).T).mean())) for c in ([0, 1], [2, 3]))
        a, b = (np.column_stack([p[:, c], np.ones(len(p))]) @ t.T for c, t in (([0, 1], ta), ([2, 3], tb)))
        rng = np.random.default_rng(seed)
        out = []
        for _ in range(trials):
            k = rng.choice(len(p), 4, replace=False)
            h = np.linalg.svd(_dlt(a[k, 0], a[k, 1], b[k, 0], b[k, 1]))[2][-1].reshape(3, 3)
            out.append((np.linalg.inv(tb) @ h @ ta).ravel().tolist())
        return pd.DataFrame({key: pool[key].iloc[0], "trial": np.arange(trials, dtype=np.int32), "w": out})

    models = kept(_pool(matches, key, row, POOL).groupBy(key).applyInPandas(draw, f"{key} {kind}, trial int, w array<double>"))

    def judge(pts: pd.DataFrame, w: np.ndarray):
        p = pts[names].to_numpy(float)

        def squares():
            for i, j in _pieces(len(p), 1024):
                q = np.column_stack([p[i:j, :2], np.ones(j - i)]).T
                x, y, z = (w[:, 3 * r : 3 * r + 3] @ q for r in range(3))
                z = np.where(z == 0, np.nan, z)
                yield np.nan_to_num((x / z - p[i:j, 2]) ** 2 + (y / z - p[i:j, 3]) ** 2, nan=np.inf)

        yield 0, threshold, squares()

    best = _counted(matches, models, key, row, judge)
    chosen = best.join(models, [key, "trial"]).select(key, F.col("w").alias("h"))

    def errors(df: DataFrame, h: DataFrame) -> DataFrame:
        joined = df.join(h.select(key, F.col("h").alias("_h")), key)
        x, y = apply_homography(F.col("_h"), F.col("x_a"), F.col("y_a"))
        return joined.withColumn("error_px", F.hypot(x - F.col("x_b"), y - F.col("y_b"))).drop("_h")

    marked = errors(matches, chosen).withColumn("inlier", F.coalesce(F.col("error_px") <= threshold, F.lit(False))).drop("error_px")
    inside = marked.where("inlier")
    centre = inside.groupBy(key).agg(*(F.avg(c).alias(f"_m{k}") for k, c in enumerate(names)), F.count("*").alias("_n"))
    spread = inside.join(centre, key).groupBy(key, "_m0", "_m1", "_m2", "_m3", "_n").agg(*(F.avg(F.hypot(F.col(names[2 * s]) - F.col(f"_m{2 * s}"), F.col(names[2 * s + 1]) - F.col(f"_m{2 * s + 1}"))).alias(f"_s{s}") for s in (0, 1)))
    scaled = inside.join(spread.drop("_n"), key)
    for s, c in ((0, "a"), (1, "b")):
        unit = F.sqrt(F.lit(2.0)) / F.nullif(F.col(f"_s{s}"), F.lit(0.0))
        scaled = scaled.withColumns({f"_{a}{c}": (F.col(f"{a}_{c}") - F.col(f"_m{2 * s + k}")) * unit for k, a in enumerate(("x", "y"))})
    x, y, u, v = (F.col(c) for c in ("_xa", "_ya", "_xb", "_yb"))
    zero, one = F.lit(0.0), F.lit(1.0)
    first, second = [-x, -y, -one, zero, zero, zero, u * x, u * y, u], [zero, zero, zero, -x, -y, -one, v * x, v * y, v]
    products = [F.sum(first[i] * first[j] + second[i] * second[j]).alias(f"p{i}{j}") for i in range(9) for j in range(i, 9)]
    sums = scaled.groupBy(key).agg(*products).join(spread, key)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = np.zeros((9, 9))
                for i in range(9):
                    for j in range(i, 9):
                        a[i, j] = a[j, i] = r[f"p{i}{j}"]
                h = np.linalg.eigh(a)[1][:, 0].reshape(3, 3)
                ta, tb = _scaled(np.array([r["_m0"], r["_m1"]]), r["_s0"]), _scaled(np.array([r["_m2"], r["_m3"]]), r["_s1"])
                h = np.linalg.inv(tb) @ h @ ta
                out.append((h / h[2, 2]).ravel().tolist())
            yield pd.DataFrame({key: pdf[key], "h": out, "n_inliers": pdf["_n"]})

    fit = sums.mapInPandas(solve, f"{key} {kind}, h array<double>, n_inliers long")
    return fit, errors(marked, fit)


def reprojection_stats(matches: DataFrame, key: str = "calibration_id") -> DataFrame:
    """Mean, median, population deviation and largest error_px of the inliers, with counts and percents."""
    e = F.when(F.col("inlier"), F.col("error_px"))
    return matches.groupBy(key).agg(
        F.count("*").alias("n_total"), F.count(e).alias("n_inliers"), (100 * F.count(e) / F.count("*")).alias("percent_inliers"),
        F.avg(e).alias("mean_px"), F.percentile(e, F.lit(HALF)).alias("median_px"), F.stddev_pop(e).alias("std_px"), F.max(e).alias("max_px"),
    )


def equal_bins(values: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) of `bins` equal bins between the least and the largest value; the largest falls into the last. Empty bins are left out."""
    low, high = values.agg(F.min(value), F.max(value)).first()
    placed = values.where(F.col(value).isNotNull())
    at = F.floor((F.col(value) - F.lit(low)) / F.nullif(F.lit(high) - F.lit(low), F.lit(0.0)) * bins)
    return placed.groupBy(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def common_positions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stage positions that both cameras have."""
    keys = ["stage_x", "stage_y"]
    return a.select(*keys).intersect(b.select(*keys))
