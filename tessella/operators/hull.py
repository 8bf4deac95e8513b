"""Convex hulls of labelled voxels, with their volume and the convexity of an object.

Only corners of a hull matter, so points fall away before they meet: of each line of voxels along x the two ends stay, found by a plain
aggregation; of each plane the corners of its flat hull; and these, some hundreds a plane, make the hull of the object. Voxels are unit
cubes, so all numbers are whole and all tests exact, and flat objects have a volume.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def flat_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of whole points (x, y), without those on edges, by the two chains over sorted points."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    chains = []
    for ordered in (points, points[::-1]):
        chain: list[np.ndarray] = []
        for p in ordered:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return np.array(chains)


def _first_four(p: np.ndarray) -> list[int]:
    """Four points that span a volume; fewer if all lie in one plane."""
    chosen = [0]
    far = np.abs(p - p[0]).sum(1)
    if far.max() == 0:
        return chosen
    chosen.append(int(far.argmax()))
    area = np.abs(np.cross(p - p[0], p[chosen[1]] - p[0])).sum(1)
    if area.max() == 0:
        return chosen
    chosen.append(int(area.argmax()))
    height = np.abs((p - p[0]) @ np.cross(p[chosen[1]] - p[0], p[chosen[2]] - p[0]))
    return chosen if height.max() == 0 else [*chosen, int(height.argmax())]


def hull_faces(p: np.ndarray) -> np.ndarray:
    """Triangles of the convex hull of whole points, corners in order seen from outside; none if all lie in one plane.

    Points are added one by one: the faces that see a point go, and their rim is joined to it. A rim's edge never points at the point, because
    then neither of its faces would see it; so no face is without area.
    """
    four = _first_four(p)
    if len(four) < 4:
        return np.zeros((0, 3), np.int64)
    a, b, c, d = four
    if np.dot(np.cross(p[b] - p[a], p[c] - p[a]), p[d] - p[a]) > 0:
        b, c = c, b
    faces = np.array([[a, b, c], [a, c, d], [a, d, b], [b, d, c]])
    normal = np.cross(p[faces[:, 1]] - p[faces[:, 0]], p[faces[:, 2]] - p[faces[:, 0]])
    level = (normal * p[faces[:, 0]]).sum(1)
    # Far points first: most others lie inside then.
    for i in np.argsort(-((p * len(p) - p.sum(0)).astype(float) ** 2).sum(1), kind="stable"):
        seen = normal @ p[i] > level
        if not seen.any():
            continue
        lit = faces[seen]
        edges = np.concatenate([lit[:, [0, 1]], lit[:, [1, 2]], lit[:, [2, 0]]])
        there = set(map(tuple, edges.tolist()))
        rim = np.array([e for e in edges.tolist() if (e[1], e[0]) not in there])
        fresh = np.column_stack([rim, np.full(len(rim), i)])
        turned = np.cross(p[fresh[:, 1]] - p[fresh[:, 0]], p[fresh[:, 2]] - p[fresh[:, 0]])
        faces, normal = np.concatenate([faces[~seen], fresh]), np.concatenate([normal[~seen], turned])
        level = np.concatenate([level[~seen], (turned * p[fresh[:, 0]]).sum(1)])
    return faces


def hull_size(p: np.ndarray) -> tuple[float, float, int]:
    """Volume, area and corners of the convex hull of whole points."""
    p = p - p.min(0)
    faces = hull_faces(p)
    if not len(faces):
        return 0.0, 0.0, 0
    a, b, c = (p[faces[:, k]] for k in range(3))
    turned = np.cross(b - a, c - a)
    return float((a * np.cross(b, c)).sum()) / 6, float(np.sqrt((turned.astype(float) ** 2).sum(1)).sum()) / 2, len(np.unique(faces))


def convexity(voxels: DataFrame) -> DataFrame:
    """label, volume, hull_volume, hull_area and convexity - the share of the hull that is the object - of every label but 0, over all its times and channels.

    A task holds the line ends of one plane, or the corners of one object's planes: for an object of 10**7 voxels that fills a ball, some 10**4 rows.
    """
    own = voxels.where("label <> 0").select("label", "t", "ch", *(F.col(c).cast("long").alias(c) for c in ("z", "y", "x")))
    lines = own.groupBy("label", "t", "ch", "z", "y").agg(F.min("x").alias("low"), (F.max("x") + 1).alias("high"), F.count(F.lit(1)).alias("n"))
    # A line's corners lie in the planes below and above it, on both sides.
    corners = lines.select("label", F.explode(F.array(F.col("z"), F.col("z") + 1)).alias("z"), "y", "low", "high")
    corners = corners.select("label", "z", F.explode(F.array(F.col("y"), F.col("y") + 1)).alias("y"), "low", "high")
    ends = corners.groupBy("label", "z", "y").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def plane(table: pa.Table) -> pa.Table:
        y, low, high = (table[c].to_numpy() for c in ("y", "low", "high"))
        flat = flat_hull(np.concatenate([np.column_stack([low, y]), np.column_stack([high, y])]))
        first = table.select(["label", "z"]).take(pa.array(np.zeros(len(flat), np.int64)))
        return pa.table({"label": first["label"], "z": first["z"], "y": pa.array(flat[:, 1]), "x": pa.array(flat[:, 0])})

    def whole(table: pa.Table) -> pa.Table:
        volume, area, _ = hull_size(np.column_stack([table[c].to_numpy() for c in ("x", "y", "z")]))
        return pa.table({"label": table["label"].slice(0, 1), "hull_volume": [volume], "hull_area": [area]})

    kind = own.schema["label"].dataType.simpleString()
    flat = ends.groupBy("label", "z").applyInArrow(plane, f"label {kind}, z long, y long, x long")
    hulls = flat.groupBy("label").applyInArrow(whole, f"label {kind}, hull_volume double, hull_area double")
    sizes = lines.groupBy("label").agg(F.sum("n").alias("volume"))
    return sizes.join(hulls, "label").select("label", "volume", "hull_volume", "hull_area", (F.col("volume") / F.col("hull_volume")).alias("convexity"))
