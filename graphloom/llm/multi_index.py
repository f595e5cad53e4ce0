"""Near-duplicate embeddings: an inverted multi-index with multi-sequence traversal and exact verification.

Each half of the unit vectors has a codebook of its own; the product of the two is a grid of cells, and every vector is
indexed in its nearest cell. A vector visits cells in the order of summed half distances, generated by the multi-sequence
walk over the two sorted centroid lists, until it has visited as many as reach the target recall. The codebooks are fitted on one half
of a bounded sample of vectors. The number of visits is set on the other half, which the codebooks have not seen: by its near pairs (found by
brute force) and by made-up pairs just at the threshold, the hardest to find; it has no bound but the grid. All rows are indexed and searched.
The codebooks grow with the root of the number of vectors, and the sample with them, so that cells stay small. Candidates are verified in double precision.

Vectors of different length are never compared. Each length of more than ``own_grid`` vectors has a grid of its own; the others are so few that
all vectors of a length are one cell, in which nothing is missed.

Vectors with equal label and equal direction bits form a class that is searched once. Within a cell, members and visitors meet in blocks of
bounded size, each pair of blocks in a group of its own. A pair found from both sides is counted from one side only: a visitor knows all
cells it visits. Each block emits counts and spanning links, one row per vector at most, never its pairs. Vectors travel in the type of the table
(float or double) and are made unit vectors where they meet.

Defined results: a vector without label, null, empty, zero, or with null or non-finite components links with nothing and is
its own component; equal ids are one node and their links add up; a null id has no component and is kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chosen_path import _grouped
from .common import components, stored


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Centroids of ``x`` by Lloyd's rounds from spread-out starts."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _distances(x, centres).argmin(axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0)


def multi_sequence(a: np.ndarray, b: np.ndarray, cells: int) -> list[int]:
    """The first ``cells`` cells i * len(b) + j in the order of a[i] + b[j]."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out = [(a[ia[0]] + b[ib[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < cells:
        _, i, j = heapq.heappop(heap)
        out.append(int(ia[i]) * len(b) + int(ib[j]))
        for y in ((i + 1, j), (i, j + 1)):
            if y[0] < len(a) and y[1] < len(b) and y not in seen:
                seen.add(y)
                heapq.heappush(heap, (a[ia[y[0]]] + b[ib[y[1]]], *y))
    return out


class Grid:
    """Codebooks of both halves, and the number of cells that a search visits."""

    def __init__(self, fitted: np.ndarray, unseen: np.ndarray, labels: np.ndarray, at_least: float, codes: int, target: float):
        """Unit vectors to fit the codebooks on, and others (with their labels) to set the number of visits by."""
        self.half = max(1, fitted.shape[1] // 2)
        self.first, self.second = kmeans(fitted[:, : self.half], codes), kmeans(fitted[:, self.half :], codes) if fitted.shape[1] > 1 else np.zeros((1, 0))
        self.most = len(self.first) * len(self.second)
        self.cells, self.recall = self._calibrated(unseen, labels, at_least, target)

    def visits(self, x: np.ndarray, cells: int | None = None) -> np.ndarray:
        a, b = _distances(x[:, : self.half], self.first), _distances(x[:, self.half :], self.second)
        return np.array([multi_sequence(a[k], b[k], cells or self.cells) for k in range(len(x))], np.int32).reshape(len(x), -1)

    def _calibrated(self, x: np.ndarray, labels: np.ndarray, at_least: float, target: float) -> tuple[int, float]:
        """The visits after which the share ``target`` of near pairs is found from either side, and the share that is found then."""
        p, q = [], []
        for k in range(0, len(x), 512):
            i, j = np.nonzero((x[k : k + 512] @ x.T >= at_least) & (labels[k : k + 512, None] == labels[None, :]))
            p.append(i[i + k < j] + k)
            q.append(j[i + k < j])
        p, q = np.concatenate(p), np.concatenate(q)
        if len(p) > 20_000:
            p, q = (v[np.linspace(0, len(v) - 1, 20_000).astype(int)] for v in (p, q))
        rng = np.random.default_rng(5)
        one = x[np.linspace(0, len(x) - 1, min(2000, len(x))).astype(int)]
        noise = rng.normal(size=one.shape)
        noise -= (noise * one).sum(axis=1)[:, None] * one
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
        every = np.concatenate([x, at_least * one + np.sqrt(max(0.0, 1 - at_least**2)) * noise])
        p, q = np.concatenate([p, np.arange(len(one))]), np.concatenate([q, len(x) + np.arange(len(one))])
        most = min(64, self.most)
        while True:
            visits = self.visits(every, most)
            home = visits[:, 0]
            met = [np.where(hit.any(axis=1), hit.argmax(axis=1), most) for hit in (visits[p] == home[q, None], visits[q] == home[p, None])]
            needed = np.sort(np.minimum(*met)) + 1
            cells = max(int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]), min(4, self.most))
            if cells <= most:
                return cells, float((needed <= cells).mean())
            most = min(2 * most, self.most)


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x, ka, kb): the vector is null if it links with nothing; the keys name its label and direction."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    x = F.col("embedding").cast(kind)
    fine = F.forall(F.coalesce("x", F.array().cast(kind)), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform("x", lambda v: v.cast("double") / F.col("top"))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, v: s + v * v))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), x.alias("x"))
        .withColumn("x", F.when(fine & (F.size("x") > 0) & F.col("label").isNotNull(), F.col("x")))
        .withColumn("top", F.array_max(F.transform("x", F.abs)).cast("double"))
        .withColumn("x", F.when(F.col("top") > 0, F.col("x")))
        .withColumn("scaled", F.when(F.col("top") > 0, scaled))
        .withColumn("unit", F.transform("scaled", lambda v: v / norm))
        .select("vec_id", "label", "x", *[F.when(F.col("x").isNotNull(), k).alias(n) for k, n in ((F.xxhash64("label", "unit"), "ka"), (F.hash("unit", "label"), "kb"))])
    )


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(float)
    rows = rows / np.abs(rows).max(axis=1)[:, None]
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _grids(classes: DataFrame, at_least: float, cell_members: int, target: float, sample: int, most_sample: int, own_grid: int) -> dict[int, Grid]:
    """A grid for each length of which there are more than ``own_grid`` vectors, and for the most frequent one."""
    lengths = classes.groupBy(F.size("x").alias("d")).count()
    often = lengths.where(F.col("count") > own_grid).collect() or lengths.orderBy(F.desc("count"), "d").limit(1).collect()
    grids = {}
    for r in often:
        codes = max(8, int(np.sqrt(r["count"] / cell_members)))
        wanted = min(max(sample, 32 * codes), most_sample)
        picked = classes.where(F.size("x") == r["d"]).orderBy(F.xxhash64("ka", F.lit(9)), "ka", "kb").limit(wanted).select("label", "x").collect()
        x = _units(np.array([v["x"] for v in picked]))
        names = {v: k for k, v in enumerate(dict.fromkeys(v["label"] for v in picked))}
        labels = np.array([names[v["label"]] for v in picked])
        half = len(x) // 2 if len(x) > 1 else 0
        grids[r["d"]] = Grid(x[half:], x[:half] if half else x, labels[:half] if half else labels, at_least, codes, target)
    return grids


def near_duplicates(
    vectors: DataFrame, at_least: float = 0.93, cell_members: int = 200, target: float = 0.999, sample: int = 4000, most_sample: int = 400_000, own_grid: int = 100_000, block: int = 1024
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    The sample has ``sample`` vectors, or 32 for each code of a larger codebook, but ``most_sample`` at most."""
    spark = vectors.sparkSession
    units = stored(_usable(vectors), "units")
    # as rows may repeat, an id counts once in its class
    classes = stored(
        units.where("x IS NOT NULL").groupBy("ka", "kb").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("x").alias("x")), "classes"
    )
    grids = spark.sparkContext.broadcast(_grids(classes, at_least, cell_members, target, sample, most_sample, own_grid))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                size = pc.list_value_length(part.column(0)).to_numpy()
                for d in np.unique(size):
                    same = part.filter(pa.array(size == d))
                    grid = grids.value.get(int(d))
                    if grid is None:
                        v = np.zeros((same.num_rows, 1), np.int32)
                    else:
                        v = grid.visits(_units(same.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
                    yield pa.RecordBatch.from_arrays([lists, *same.columns], ["visits", *same.schema.names])

    kinds = {n: classes.schema[n].dataType.simpleString() for n in ("x", "label")}
    seen = stored(classes.select("x", "ka", "kb", "copies", "label").mapInArrow(visit, f"visits array<int>, x {kinds['x']}, ka long, kb int, copies long, label {kinds['label']}"), "visits")
    # every class is a member of its home cell and a visitor of the others; in its home cell it is met once
    at_home = seen.select("*", F.get("visits", F.lit(0)).alias("home"), F.size("x").alias("d"))
    sizes = at_home.groupBy("label", "d", "home").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = at_home.select("label", "d", F.posexplode("visits").alias("nth", "cell"), "x", "ka", "kb", "copies", "home", "visits").join(
        sizes.withColumnRenamed("home", "cell"), ["label", "d", "cell"]
    )
    mine = F.pmod(F.xxhash64("ka", "kb"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # members of block m go to the groups (m, v) of all visitor blocks v; visitors of block v to all (m, v). Homes count as both.
    place = ("label", "d", "cell")
    dealt = rows.withColumn("mine", mine).select(
        F.explode(F.transform(every, lambda o: F.when(F.col("nth") == 0, F.xxhash64(*place, F.least(o, F.col("mine")), F.greatest(o, F.col("mine")))).otherwise(F.xxhash64(*place, o, o)))).alias("meeting"),
        F.when(F.col("nth") == 0, F.col("mine")).otherwise(-1).alias("block"), "ka", "kb", "copies", "home", "x", F.when(F.col("nth") == 0, F.col("visits")).alias("visits"),
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        for _, group in _grouped(batches, 0):
            _meet(group, at_least, out)
            if len(out[0]) > 20_000:
                yield _links(out)
                out = [[], [], [], [], []]
        yield _links(out)

    met = dealt.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(verify, "ka long, kb int, links long, root_a long, root_b int")
    found = stored(met.groupBy("ka", "kb", "root_a", "root_b").agg(F.sum("links").alias("links")), "links")
    least = classes.select("ka", "kb", "least", "copies")
    edges = found.where("NOT (ka <=> root_a AND kb <=> root_b)").select("ka", "kb", "root_a", "root_b").join(least.select("ka", "kb", F.col("least").alias("a")), ["ka", "kb"]).join(least.select(F.col("ka").alias("root_a"), F.col("kb").alias("root_b"), F.col("least").alias("b")), ["root_a", "root_b"])
    reach = components(edges.select("a", "b"))
    counted = found.groupBy("ka", "kb").agg(F.sum("links").alias("links"))
    told = least.join(counted, ["ka", "kb"], "left").join(reach, F.col("least") == F.col("node"), "left").select("ka", "kb", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "least").alias("component"))
    return (
        units.select("vec_id", "ka", "kb")
        .join(told, ["ka", "kb"], "left")
        .select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"),
            F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
        )
    )


def _links(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["ka", "kb", "links", "root_a", "root_b"])


def _meet(group: list, at_least: float, out: list[list]) -> None:
    """Adds, for each class of a meeting with links, their number (in vectors) and its root among the classes linked here.

    Members of two different blocks are compared across blocks only; those of a block in its own meeting with each other and with visitors.
    """
    block = np.array([r[0].as_py() for r in group])
    home = block >= 0
    if not home.any():
        return
    ka, kb = [r[1].as_py() for r in group], [r[2].as_py() for r in group]
    copies = np.array([r[3].as_py() for r in group], np.int64)
    own = np.array([r[4].as_py() for r in group])
    unit = _units(np.stack([r[5].values.to_numpy() for r in group]))
    members = np.flatnonzero(home)
    across = len(np.unique(block[members])) > 1
    visits = np.stack([group[i][6].values.to_numpy() for i in members])
    links = np.zeros(len(group), np.int64)
    root = np.arange(len(group))
    for k in range(0, len(group), 256):
        rows = np.arange(k, min(k + 256, len(group)))
        near = unit[rows] @ unit[members].T >= at_least
        at_home = home[rows]
        near[at_home] &= rows[at_home, None] > members[None, :]
        if across:
            near[at_home] &= block[rows][at_home, None] != block[members][None, :]
        links[rows] += near @ copies[members]
        i, j = np.nonzero(near)
        # the member's own search found a visitor if it went to the visitor's home
        twice = ~at_home[i] & (visits[j] == own[rows[i], None]).any(axis=1)
        np.add.at(links, members[j[~twice]], copies[rows[i[~twice]]])
        for r in np.flatnonzero(near.any(axis=1)):
            joined = np.unique(root[np.append(members[near[r]], rows[r])])
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
    for k in np.flatnonzero(links):
        for c, v in zip(out, (ka[k], kb[k], int(links[k]), ka[root[k]], kb[root[k]]), strict=True):
            c.append(v)
