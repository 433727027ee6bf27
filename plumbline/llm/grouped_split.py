"""Train, validation and test splits that keep related records together.

A component is all records with one group key; a record without a key is a component of its own. Every component starts
in the split its hash says. Annealing then moves components to another split, or exchanges two of them, accepting what
lowers the deviation from the wanted sizes, overall and per label, and now and then what raises it; several replicas run
and the best is kept.

The components are divided into blocks by hash, and each block anneals on its own towards its share of the wanted sizes,
so that nothing but counts per label ever meets in one place. Components too large for a block, of which there are at most
1 / LARGE, are annealed first, on the driver, and the blocks then make up for what those leave.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import group_of, split_of
from ..operators.skew import among, join_skewed
from ..storage import cut
from .batches import column, gathered, parts

SPLITS = ("train", "val", "test")
SHARES = (0.70, 0.15, 0.15)
#: A component with more than this share of all records is annealed on the driver.
LARGE = 1 / 500
#: Components in one block, about.
BLOCK = 10_000
REPLICAS = 3
#: Proposals per component and replica.
SWEEPS = 4
ASSIGNED = "component string, split string"
_ASSIGNED = pa.schema([("component", pa.string()), ("split", pa.string())])


def files_of(index: DataFrame) -> DataFrame:
    """One row per file: file_id, label, component."""
    own = F.concat(F.lit("file:"), F.col("file_id").cast("string"))
    rows = index.select("file_id", F.coalesce(F.col("label"), F.lit("(none)")).alias("label"), F.coalesce(F.concat(F.lit("group:"), group_of(F.col("group_key"))), own).alias("component"))
    return rows.dropDuplicates(["file_id"])


def anneal(components: list[list[tuple[int, int]]], start: list[int], target: np.ndarray, seed: int, replicas: int = REPLICAS, sweeps: int = SWEEPS) -> list[int]:
    """The split of each component. components: (label, records) of each; target: records wanted by split and label.

    The deviation is the sum over splits and labels of (records - wanted)^2 / wanted records of the label, plus the same
    for all labels together, which count as one more label.
    """
    labels = target.shape[1]
    parts = [[*c, (labels, sum(v for _, v in c))] for c in components]
    wanted = np.concatenate([target, target.sum(1, keepdims=True)], 1)
    weight = (1 / np.maximum(1, np.abs(wanted).sum(0))).tolist()
    n, best, best_cost = len(parts), list(start), float("inf")
    if not n:
        return best
    rng = np.random.default_rng(seed)
    for _ in range(replicas):
        split, off = list(start), (-wanted).tolist()
        for c, s in zip(parts, split, strict=True):
            for k, v in c:
                off[s][k] += v

        def move(c: int, u: int) -> float:
            """Moves component c to split u; returns the change of the deviation."""
            src, dst, change = off[split[c]], off[u], 0.0
            for k, v in parts[c]:
                change += 2 * v * (v + dst[k] - src[k]) * weight[k]
                src[k] -= v
                dst[k] += v
            split[c] = u
            return change

        cost = sum(x * x * w for row in off for x, w in zip(row, weight, strict=True))
        heat0 = cost / n
        for sweep in range(sweeps + 1):
            if cost < best_cost:
                best, best_cost = list(split), cost
            if sweep == sweeps:
                break
            heat = heat0 * (1 - (sweep + 1) / sweeps) ** 2  # the last sweep only improves
            who, partner = rng.integers(0, n, n).tolist(), rng.integers(0, n, n).tolist()
            step, luck, swap = rng.integers(1, 3, n).tolist(), (-np.log(rng.random(n) + 1e-300) * heat).tolist(), (rng.random(n) < 0.3).tolist()
            for c, e, t, limit, both in zip(who, partner, step, luck, swap, strict=True):
                s = split[c]
                u = split[e] if both else (s + t) % 3
                if u == s:
                    continue
                change = move(c, u)
                if both:
                    change += move(e, s)
                if change > limit:
                    move(c, s)
                    if both:
                        move(e, u)
                else:
                    cost += change
    return best


def hashed(component: str) -> int:
    """The split a component starts in."""
    x = int.from_bytes(hashlib.blake2b(component.encode(), digest_size=8).digest()) / 2**64
    return 0 if x < SHARES[0] else 1 if x < SHARES[0] + SHARES[1] else 2


def _block(labels: list[str], share: np.ndarray):
    """Anneals the components of one partition towards ``share``, by split and label, of the partition's records."""
    place = {x: k for k, x in enumerate(labels)}

    def run(batches):
        t = gathered(batches)
        if t is None:
            return
        own: dict[str, list[tuple[int, int]]] = {}
        for name, label, n in zip(t["component"].to_pylist(), t["label"].to_pylist(), column(t, "n").tolist(), strict=True):
            own.setdefault(name, []).append((place[label], n))
        names = sorted(own)  # whatever order the rows came in
        of = [own[x] for x in names]
        have = np.zeros(len(labels))
        for c in of:
            for k, v in c:
                have[k] += v
        split = anneal(of, [hashed(x) for x in names], share * have, len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([SPLITS[s] for s in split], pa.string())], schema=_ASSIGNED)

    return run


def assign(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """``files(file_id, label, component)``, one row each, with ``split``: near 70/15/15 overall and per label, all files of a
    component in the same split. An empty table gives an empty result. Labels are expected to be few (their counts are
    collected); components may be any number and any size."""
    files = cut(files)
    counts = cut(files.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")))
    rows = counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy("label").collect()
    labels, total = [r.label for r in rows], np.array([float(r.n) for r in rows])
    limit = float(total.sum() * LARGE)
    sizes = counts.groupBy("component").agg(F.sum("n").alias("size"))
    large = [r.component for r in sizes.where(F.col("size") > max(limit, 1.0)).select("component").collect()]
    share, fixed = np.tile(np.array(SHARES)[:, None], (1, len(labels))), {}
    if large:
        place, of = {x: k for k, x in enumerate(labels)}, {x: [] for x in sorted(large)}
        for r in counts.where(among(F.col("component"), large)).collect():  # at most 1 / LARGE components times the labels
            of[r.component].append((place[r.label], r.n))
        rest = total - sum(np.bincount([k for k, _ in c], [v for _, v in c], len(labels)) for c in of.values())
        # The small components can still fill every split, so large ones only must not exceed what is wanted.
        split = anneal([sorted(c) for c in of.values()], [hashed(x) for x in of], share * (total - rest), 1, REPLICAS, 200)
        fixed = dict(zip(of, split, strict=True))
        left = share * total
        for c, s in zip(of.values(), split, strict=True):
            for k, v in c:
                left[s, k] -= v
        left = np.maximum(left, 0)
        share = left / np.maximum(left.sum(0), 1e-9)
    n = sizes.count()
    small = counts.where(~among(F.col("component"), large)).repartition(parts(n, block, 1), "component")
    split = small.mapInArrow(_block(labels, share), ASSIGNED)
    if fixed:
        split = split.unionByName(files.sparkSession.createDataFrame([(c, SPLITS[s]) for c, s in fixed.items()], ASSIGNED))
    return join_skewed(files, cut(split), "component", large, "inner")


def torn(index: DataFrame) -> DataFrame:
    """The group keys, trimmed and in lower case, whose files are in more than one of train, val and test. Null and empty
    keys and the text nan are no groups, null and unknown splits no splits; repeated rows change nothing; an empty table gives an empty result."""
    bit = F.when(split_of(F.col("split")) == "train", 1).when(split_of(F.col("split")) == "val", 2).when(split_of(F.col("split")) == "test", 4)
    rows = index.select(group_of(F.col("group_key")).alias("group_key"), bit.alias("bit")).where("group_key IS NOT NULL AND bit IS NOT NULL")
    return rows.groupBy("group_key").agg(F.bit_or("bit").alias("bits")).where(F.bit_count("bits") > 1).select("group_key")
