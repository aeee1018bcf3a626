"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors become one class.  Classes are dealt to cells around pivots and
cut into blocks.  Centres and radii alone decide which blocks may hold a link;
only those meet; a task holds a few blocks of one region, and others pass by.
In each tile of two blocks, vectors are quantised to int8
and multiplied as integers, and the quantisation errors of both vectors bound
how far the product can be from the cosine.  Only pairs that may reach the
threshold are computed again in double precision.  A task returns counts and a
spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import connected_components, materialise

PIVOTS, MOST_PIVOTS = 64, 4096
BLOCK = 1024
HEADS = 1024  # blocks whose centres are compared with each other in one task
TEAM = 8  # blocks that a task holds; a power of two
PARTNERS = 64  # blocks that pass by them in one task
RECOMPUTE = 100_000  # pairs computed again at once
SLACK = 1e-6


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8, their scales, and the exact norms of what quantisation lost (a little up)."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    lost = np.linalg.norm(unit - q * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), scale, lost


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows; 1024 terms of at most 127**2 stay exact in float32."""
    d = a.shape[1]
    if d <= 1024:
        return a.astype(np.float32) @ b.astype(np.float32).T
    out = np.zeros((len(a), len(b)))
    for k in range(0, d, 1024):
        out += a[:, k:k + 1024].astype(np.float32) @ b[:, k:k + 1024].astype(np.float32).T
    return out


def links(a: dict, b: dict, least: float, same: bool):
    """Index pairs of blocks ``a`` and ``b`` with cosine >= least, in parts."""
    if not same:
        gap = np.arccos(np.clip(a["centre"] @ b["centre"], -1, 1)) - a["radius"] - b["radius"]
        if gap > np.arccos(least) + SLACK:
            return
    product = integer_products(a["q"], b["q"])
    product *= b["scale"][None, :].astype(product.dtype)
    # |u.v - q| <= (1 + lost_u) lost_v + lost_u
    reach = (least - SLACK - a["lost"] - (1 + a["lost"]) * b["lost"].max()) / a["scale"]
    i, j = np.nonzero(product >= reach[:, None].astype(product.dtype) * (1 - 1e-6))
    if same:
        upper = i < j
        i, j = i[upper], j[upper]
    for lo in range(0, len(i), RECOMPUTE):
        ii, jj = i[lo:lo + RECOMPUTE], j[lo:lo + RECOMPUTE]
        u, v = a["x"][ii].astype(np.float64), b["x"][jj].astype(np.float64)
        cosine = np.einsum("ij,ij->i", u, v) / (a["norm"][ii] * b["norm"][jj])
        near = cosine >= least
        yield ii[near], jj[near]


class Forest:
    """Union by smaller label; remembers the links that joined two parts."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.joined: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def add(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.joined.append((x, y))


def unpack(block: int, d: int, wide: bool, ids: bytes, many: bytes, x: bytes, centre: bytes, radius: float) -> dict:
    x = np.frombuffer(x, np.float64 if wide else np.float32).reshape(-1, d).astype(np.float64)
    q, scale, lost = quantise(x)
    return {"block": block, "id": np.frombuffer(ids, np.int64), "many": np.frombuffer(many, np.int64), "x": x, "q": q, "scale": scale,
            "lost": lost, "norm": np.linalg.norm(x, axis=1), "centre": np.frombuffer(centre, np.float64), "radius": radius}


def valid(embedding):
    """Neither null nor empty, without null or non-finite components, and not all zero."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embedding.isNotNull() & ~bad & F.exists(embedding, lambda v: v != 0)


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors that can't be compared (null, zero, null or non-finite components)
    link with nothing; vectors of different lengths do not link with each other.
    Equal vectors link with each other.  Rows that repeat an id are vectors of
    their own.  An empty table gives no rows.
    """
    x = F.col(vector_col).cast("array<double>")
    rows = materialise(vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("vec_id"),
                                      x.alias("x"), F.coalesce(valid(x), F.lit(False)).alias("ok")), "vectors")
    classes = materialise(rows.where("ok").groupBy("x").agg(
        F.min("rid").alias("id"), F.count(F.lit(1)).alias("many")), "classes")
    found = tile_links(classes, least)
    edges = found.where("v is not null").select("u", "v")
    counts = found.where("links is not null").groupBy("u").agg(F.sum("links").alias("links"))
    parts = connected_components(edges)
    member = rows.where("ok").join(classes, "x").select("rid", "vec_id", "id", "many")
    member = materialise(
        member.join(counts.withColumnRenamed("u", "id"), "id", "left").join(
            parts.withColumnRenamed("node", "id"), "id", "left").select(
            "rid", "vec_id", F.coalesce("component", "id").alias("component"),
            (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "members")
    names = materialise(member.groupBy("component").agg(F.min("vec_id").alias("component_id")), "names")
    linked = member.join(names, "component").select("vec_id", F.col("n_links").cast("long"), "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                        F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


BLOCKS = "block long, d long, wide boolean, ids binary, many binary, x binary, centre binary, radius double"
FOUND = "u long, v long, links long"


def cut_blocks(classes: DataFrame) -> DataFrame:
    """Written blocks of at most ``BLOCK`` vectors of one cell, with their balls.

    Vectors go to the nearest of some pivots, which grow with the vectors up to
    ``MOST_PIVOTS``; large cells are cut by a hash.  Components move in four
    bytes where that loses nothing.
    """
    n = classes.count()
    wanted = min(max(PIVOTS, -(-n // (2 * BLOCK))), MOST_PIVOTS)
    sample = classes.orderBy(F.xxhash64("x")).limit(wanted).select("x").toPandas()  # a bounded number of rows
    pivots: dict[int, np.ndarray] = {}
    for v in map(np.array, sample["x"]):
        pivots.setdefault(len(v), []).append(v / np.linalg.norm(v))
    pivots = {d: np.stack(v) for d, v in pivots.items()}

    def assign(frames):
        for f in frames:
            cell = [int((pivots[len(v)] @ v).argmax()) if len(v) in pivots else 0 for v in f["x"]]
            yield f.assign(d=f["x"].map(len), cell=cell)

    celled = materialise(classes.mapInPandas(assign, "x array<double>, id long, many long, d int, cell int"), "cells")
    sizes = celled.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n"))
    salted = celled.join(sizes, ["d", "cell"]).withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / (BLOCK * 3 // 4))))

    def block(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        out = []
        for lo in range(0, len(f), BLOCK):
            part = f.iloc[lo:lo + BLOCK]
            x = np.stack(part["x"].to_numpy()).astype(np.float64)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            centre = unit.mean(axis=0)
            length = np.linalg.norm(centre)
            centre = centre / length if length > 1e-9 else unit[0]
            radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
            with np.errstate(over="ignore"):
                narrow = x.astype(np.float32)
            wide = bool((narrow != x).any())
            out.append((x.shape[1], wide, part["id"].to_numpy(np.int64).tobytes(), part["many"].to_numpy(np.int64).tobytes(),
                        (x if wide else narrow).tobytes(), centre.tobytes(), radius))
        return pd.DataFrame(out, columns=["d", "wide", "ids", "many", "x", "centre", "radius"])

    # by ranges of the cell: blocks with neighbouring numbers are near each other
    blocks = salted.repartitionByRange("d", "cell", "salt").groupBy("d", "cell", "salt").applyInPandas(block, BLOCKS.partition(", ")[2])
    return materialise(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")


def near_blocks(blocks: DataFrame, least: float) -> DataFrame:
    """``a, b``: pairs of blocks, and blocks with themselves, whose balls are near enough to hold a link.

    Only centres and radii move: one row in place of a thousand vectors.
    """
    heads = blocks.select("block", "d", "centre", "radius")
    groups = heads.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / HEADS).cast("int").alias("groups"))
    tiled = heads.join(groups, "d").withColumn("g", F.pmod(F.xxhash64("block"), "groups").cast("int")).withColumn(
        "o", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("lo", F.least("g", "o")).withColumn(
        "hi", F.greatest("g", "o")).select("d", "lo", "hi", "g", "block", "centre", "radius")

    def plan(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        ids, g, radius = (f[c].to_numpy() for c in ("block", "g", "radius"))
        centre = np.stack([np.frombuffer(c, np.float64) for c in f["centre"]])
        one = f["lo"].iloc[0] == f["hi"].iloc[0]
        out = []
        for i in range(len(f)):
            gap = np.arccos(np.clip(centre[i:] @ centre[i], -1, 1)) - radius[i:] - radius[i]
            # pairs inside a group belong to the group's own tile
            near = i + np.flatnonzero((gap <= np.arccos(least) + SLACK) & (one | (g[i:] != g[i])))
            if one:
                near = np.union1d(near, [i])
            out.append(np.stack([np.full(len(near), ids[i]), ids[near]], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    return tiled.groupBy("d", "lo", "hi").applyInPandas(plan, "a long, b long")


def tile_links(classes: DataFrame, least: float) -> DataFrame:
    """``u, v, links``: either a link (u, v) of a spanning forest, or the links that u has with some blocks."""
    blocks = cut_blocks(classes)
    team = lambda c: F.floor(F.col(c) / TEAM)
    low, high = F.least(team("a"), team("b")), F.greatest(team("a"), team("b"))
    # either of two teams may lead, so that no team leads all its pairs
    leads = F.when(F.pmod(F.xxhash64(low, high), F.lit(2)) == 0, low).otherwise(high)
    pairs = near_blocks(blocks, least).select(leads.alias("team"), F.when(team("a") == leads, F.col("a")).otherwise(F.col("b")).alias("lead"),
                                              F.when(team("a") == leads, F.col("b")).otherwise(F.col("a")).alias("block"))
    mates = materialise(pairs.groupBy("team", "block").agg(F.collect_list("lead").alias("mates")), "block_pairs")
    many = mates.groupBy("team").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    asked = mates.join(many, "team").select("team", F.pmod(F.xxhash64("block"), "parts").alias("part"), "block", F.lit(1).alias("turn"), "mates")
    asked = asked.unionByName(asked.select("team", "part", F.explode("mates").alias("block")).distinct().select(
        "*", F.lit(0).alias("turn"), F.array().cast("array<bigint>").alias("mates")))

    def meet(batches):
        """A team's blocks come first in their task and are held; their partners pass by one after another."""
        key, team, forest, counts = None, {}, Forest(), {}

        def done():
            rows = [(u, v, None) for u, v in forest.joined] + [(u, None, n) for u, n in counts.items()]
            u, v, n = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (u, v, n)], names=["u", "v", "links"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(batch.num_columns))):
                number, part, turn, mates, *rest = (c.as_py() for c in row)
                held = unpack(*rest)
                if (number, part) != key:
                    yield done()
                    key, team, forest, counts = (number, part), {}, Forest(), {}
                if turn == 0:
                    team[held["block"]] = held
                for first in map(team.__getitem__, mates):
                    for i, j in links(first, held, least, first["block"] == held["block"]):
                        for mine, other in ((first["id"][i], held["many"][j]), (held["id"][j], first["many"][i])):
                            keys, inverse = np.unique(mine, return_inverse=True)
                            for k, n in zip(keys.tolist(), np.bincount(inverse, other).tolist()):
                                counts[k] = counts.get(k, 0) + int(n)
                        for u, v in zip(first["id"][i].tolist(), held["id"][j].tolist()):
                            forest.add(u, v)
        yield done()

    shipped = asked.join(blocks, "block").repartition("team", "part").sortWithinPartitions("team", "part", "turn").select(
        "team", "part", "turn", "mates", *(c.split()[0] for c in BLOCKS.split(", ")))
    return materialise(shipped.mapInArrow(meet, FOUND), "tiles")
