"""Near-duplicate documents: chosen-path set similarity join over MinHash signatures.

Documents with equal shingle sets form classes, of which one representative goes on. Each independent tree branches a
representative by the minwise tokens at a few randomly selected signature positions (1/threshold of them are expected
at a node); those with the same token share a child. Nodes of one member end; nodes of at most ``small`` members are
compared exhaustively; larger ones branch again. A large node whose members are mostly alike would not shrink by branching: it is
compared at once, as is what is still large at the last level, in blocks, each pair of blocks being a group of its own, so no group is
unbounded and no pair is left out. Nodes with the same members, in
whatever tree, are compared once. Comparing signatures only proposes clusters; links are confirmed on full shingle sets,
where postings of the members' shingles give all
intersections of a member at once and members that are already connected need none. Clusters and links are spanning edges, at most one
per member, never all pairs.

A pair at the threshold t stays together in a tree of depth d with probability of at least t^d, so ``trees`` = 12 misses one
in 10^9 at depth 1 and one in 10^5 at depth 3. Signature similarity must reach the threshold less ``slack`` (over four
standard deviations of the estimate).

Defined results: a document without words, or with null text, has an empty set, no links and itself as component; one
with fewer words than a shingle has the whole sequence as its only shingle; an id that repeats is one
node with all its texts; a null id has no
component and is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, components, gram_hashes, lower_words, mix, stored

POSITIONS = 64
#: Signature positions whose lowest bits tell how alike a node's members are.
PROBES = 8
_RNG = np.random.default_rng(7)
_MULTIPLY = (_RNG.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    return np.unique(gram_hashes(hashes.of(lower_words(text)), words))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(POSITIONS, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(shingles), 4096):
        part = (shingles[k : k + 4096, None] * _MULTIPLY + _ADD) >> np.uint64(32)
        out = np.minimum(out, part.min(axis=0).astype(np.uint32))
    return out


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig): size, a 128-bit name and the signature of each document's set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, a, b, sigs = [], [], [], []
            for value in batch.column(1):
                s = shingle_set(value.as_py(), words, hashes)
                n.append(len(s))
                a.append(int(np.add.reduce(mix(s), dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                b.append(int(np.add.reduce(mix(s ^ np.uint64(0x5DEECE66D)), dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                sigs.append(signature(s).view(np.int32))
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * POSITIONS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], ["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, "doc_id long, n_shingles long, set_a long, set_b long, sig array<int>")


def _branch(node, positions):
    return F.explode(F.transform(positions, lambda p: F.xxhash64(node, p, F.get("sig", p)))).alias("node")


def nodes_of(reps: DataFrame, threshold: float, trees: int, small: int, depth: int, block: int, dense: float = 0.3) -> DataFrame:
    """(node, rep): groups to compare, each of bounded size, of representatives (rep, sig)."""
    rng = np.random.default_rng(11)
    roots = []
    for tree in range(trees):
        chosen = np.flatnonzero(rng.random(POSITIONS) < 1 / (threshold * POSITIONS))
        for p in chosen if len(chosen) else [int(rng.integers(POSITIONS))]:
            roots.append((tree, int(p)))
    first = F.explode(F.array(*[F.xxhash64(F.lit(t), F.lit(p), F.get("sig", F.lit(p))) for t, p in roots])).alias("node")
    one = lambda p: F.get("sig", F.lit(p)).bitwiseAND(F.lit(1))
    bits = sum((F.shiftleft(one(7 * k), k) for k in range(1, PROBES)), one(0)).alias("bits")
    frontier = reps.select(first, "rep", bits)
    found = []
    chance = int((1 << 20) / (threshold * POSITIONS))
    # where most members share a value, its lowest bit is far from even: squared, the share of that value
    lean = sum(((2 * F.sum(F.shiftright("bits", k).bitwiseAND(F.lit(1))) / F.count(F.lit(1)) - 1) ** 2 for k in range(PROBES)), F.lit(0.0)) / PROBES
    for level in range(depth):
        sizes = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.sum((F.xxhash64("rep") / 2).cast("long").cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("b"), lean.alias("lean")).where("members > 1")
        once = sizes.groupBy("members", "a", "b").agg(F.min("node").alias("node"), F.min("lean").alias("lean")).select("node", "members", "lean")
        live = stored(frontier.select("node", "rep").join(once, "node"), "nodes")
        found.append(live.where(F.col("members") <= small).select("node", "rep"))
        large = live.where(F.col("members") > small)
        final = level + 1 == depth
        found.append(_in_blocks(large if final else large.where(F.col("lean") >= dense), block))
        large = large.where(F.col("lean") < dense)
        if final or not large.limit(1).count():
            break
        drawn = F.filter(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda p: F.pmod(F.xxhash64("parent", p), F.lit(1 << 20)) < chance)
        some = F.when(F.size(drawn) > 0, drawn).otherwise(F.array(F.pmod(F.xxhash64("parent", F.lit(-1)), F.lit(POSITIONS)).cast("int")))
        frontier = large.select(F.col("node").alias("parent"), "rep").join(reps, "rep").select(_branch(F.col("parent"), some), "rep", bits)
    return _union(found)


def _in_blocks(large: DataFrame, block: int) -> DataFrame:
    """Each pair of blocks of a node's members as a node of its own."""
    blocks = F.ceil(F.col("members") / block).cast("int")
    mine = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")
    return large.withColumn("blocks", blocks).withColumn("mine", mine).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("node", F.least(o, F.col("mine")), F.greatest(o, F.col("mine")), F.lit(3)))).alias("node"), "rep"
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionAll(df)
    return out


def _grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, list]]:
    """Runs of equal keys of rows that are sorted by it: (key, list of rows as tuples of Arrow scalars)."""
    now, rows = None, []
    for batch in batches:
        keys = batch.column(key).to_pylist()
        others = [batch.column(k) for k in range(batch.num_columns) if k != key]
        for i, k in enumerate(keys):
            if k != now:
                if rows:
                    yield now, rows
                now, rows = k, []
            rows.append(tuple(c[i] for c in others))
    if rows:
        yield now, rows


def propose(groups: DataFrame, reps: DataFrame, at_least: float) -> DataFrame:
    """(cluster, rep, root): members of a node that signatures connect, and the smallest of them. The same members get the
    same cluster, wherever found."""
    need = int(np.ceil(at_least * POSITIONS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters, members, roots = [], [], []
        for _, rows in _grouped(batches, 0):
            ids = np.array([r[0].as_py() for r in rows], np.int64)
            order = np.argsort(ids)
            ids = ids[order]
            sig = np.stack([r[1].values.to_numpy() for r in rows])[order]
            root = np.arange(len(ids))
            for i in range(len(ids) - 1):
                other = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
                if not len(other):
                    continue
                near = other[(sig[other] == sig[i]).sum(axis=1) >= need]
                if len(near):
                    merged = np.unique(np.append(root[near], root[i]))
                    root[np.isin(root, merged)] = merged[0]
            for r in np.unique(root):
                own = ids[root == r]
                if len(own) > 1:
                    name = int(np.add.reduce(mix(own.astype(np.uint64)), dtype=np.uint64).astype(np.int64))
                    clusters += [name] * len(own)
                    members += own.tolist()
                    roots += [int(own[0])] * len(own)
            if len(members) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (clusters, members, roots)], ["cluster", "rep", "root"])
                clusters, members, roots = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (clusters, members, roots)], ["cluster", "rep", "root"])

    dealt = groups.join(reps, "rep").select("node", "rep", "sig").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(task, "cluster long, rep long, root long").distinct()


def gathered(clusters: DataFrame, most: int) -> DataFrame:
    """(cluster, rep): clusters that share members become one, if that has at most ``most`` members; others stay as they are.

    A representative is then compared in one place, not once for each tree that proposed it."""
    whole = stored(components(clusters.select(F.col("rep").alias("a"), F.col("root").alias("b"))), "gathered")
    few = whole.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("component")
    one = whole.join(few, "component").select(F.col("component").alias("cluster"), F.col("node").alias("rep"))
    rest = clusters.select("cluster", "rep").join(one.select("rep"), "rep", "left_anti").select("cluster", "rep")
    return one.unionAll(rest)


def spanning_links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links between sets (sorted arrays of distinct hashes) that connect what any links connect, at most one less than there are sets.

    Postings of the hashes give a set's intersections with all others at once; sets whose component holds all others are skipped.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(inverse, minlength=len(values))
    start = np.cumsum(count) - count
    posting = np.repeat(np.arange(m), size)[np.argsort(inverse, kind="stable")]
    root = np.arange(m)
    for i in range(m):
        if (root == root[i]).all():
            return
        own = inverse[ends[i] - size[i] : ends[i]]
        n = count[own]
        stop = np.cumsum(n)
        shared = np.bincount(posting[np.repeat(start[own] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)], minlength=m)
        near = np.flatnonzero((100 * shared >= percent * (size[i] + size - shared)) & (root != root[i]))
        for r in np.unique(root[near]):
            yield i, int(near[root[near] == r][0])
        root[np.isin(root, root[near])] = root[i]


def confirm(clusters: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): spanning links of the clusters' members, each confirmed on the full sets (rep, shingles)."""
    percent = round(100 * threshold)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, rows in _grouped(batches, 0):
            ids = [r[0].as_py() for r in rows]
            links = spanning_links([np.frombuffer(r[1].as_buffer(), np.uint64) for r in rows], percent)
            out += [(ids[i], ids[j]) for i, j in links]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = clusters.join(sets, "rep").select("cluster", "rep", "shingles").repartition("cluster").sortWithinPartitions("cluster")
    return dealt.mapInArrow(task, "a long, b long")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, sets, held = [], [], 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                sets.append(shingle_set(value.as_py(), words, hashes).tobytes())
                held += len(sets[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["rep", "shingles"])
                    ids, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["rep", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(task, "rep long, shingles binary")


def near_duplicates(
    docs: DataFrame, words: int = 5, threshold: float = 0.8, trees: int = 12, small: int = 64, depth: int = 3, block: int = 4096, slack: float = 0.2
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = stored(sketch(docs, words), "sketches")
    name = ["n_shingles", "set_a", "set_b"]
    classes = stored(sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*name).agg(F.min_by("sig", "doc_id").alias("sig"), F.min("doc_id").alias("rep")), "classes")
    reps = classes.select("rep", "sig")
    proposed = stored(propose(nodes_of(reps, threshold, trees, small, depth, block), reps, threshold - slack), "proposed")
    clusters = stored(gathered(proposed, 8 * small), "clusters")
    wanted = clusters.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    texts = docs.join(wanted, "doc_id", "left_semi").withColumn("name", F.xxhash64("text")).dropDuplicates(["doc_id", "name"])
    found = components(confirm(clusters, shingle_sets(texts, words), threshold))
    member = classes.join(found, F.col("rep") == F.col("node"), "left").select(*name, F.coalesce("component", "rep").alias("component"))
    return (
        sketches.select("doc_id", *name)
        .join(member, name, "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
        )
    )
