"""Embedding near-duplicates by robust-pruned flat graphs.

Vectors are dealt to overlapping cluster shards (each to its `overlap` nearest centroids). Every shard builds a graph:
near and random candidates, robustly pruned, with reverse edges. A vector's adjacency lists from all its shards are
united. In its home shard each vector then searches the united graph greedily from the shard's medoids and from its own
node, and expands over all nodes in range until no new one appears. What is found is verified in double precision. The
recall against brute force over all vectors is audited for a bounded set of vectors, on links between different vectors,
over all their links and as the mean of the vectors; below the target, the search runs again, first with whole shards,
then with more overlap.

The centroids are fitted on at most `sample` vectors, those with the smallest hashes of their ids; all vectors are
indexed. Shards above SPLIT vectors are dealt to finer shards, level by level, so shards keep their size as the table
grows; those above BLOCK vectors are searched in pairs of blocks. Links are counted in the task; of the links
themselves only a spanning forest leaves it. Equal vectors are one node with a multiplicity.

A task holds at most 2 * BLOCK vectors; pairs are verified as each batch of queries finds them and kept as a bit in a square
of its vectors, so a dense group costs time but no more memory than a sparse one. Where an expansion would look at more
neighbours than the shard has vectors, the queries are measured against the whole shard instead.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths never link, those of each length are searched by themselves; rows that share an id share a component
among vectors of one length; a null id counts as one id before all others and its component is null; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lakequill.llm.bytesx import groups, mixed
from lakequill.llm.common import LONG, components, settle, shuffle_width, small_batches, wider
from lakequill.llm.ngram_join import NO_ID, forest

DEGREE, NEAR, RANDOM, ALPHA = 24, 32, 16, 1.2
BEAM, MEDOIDS, SLACK = 12, 8, 0.05
BLOCK, BATCH = 4096, 512
#: Nodes expanded at a time, and numbers gathered at a time; they bound the memory of building and searching.
FRONTIER, CELLS = 20_000, 1 << 22
SAMPLE, PER_SHARD, MOST_SHARDS = 20_000, 1000, 1024
#: A shard of more vectors is dealt to finer ones, fitted on about so many of its vectors, at most so many times.
SPLIT, SHARD_SAMPLE, LEVELS = 8 * BLOCK, 8000, 4
AUDITED = 64


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def pair_sims(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of x[a] and y[b], row by row, a bounded number of them at a time."""
    out, step = np.empty(len(a)), max(1, CELLS // max(1, x.shape[1]))
    for lo in range(0, len(a), step):
        np.einsum("nd,nd->n", x[a[lo : lo + step]], y[b[lo : lo + step]], out=out[lo : lo + step])
    return out


def fit_centroids(x: np.ndarray, k: int, steps: int = 12, seed: int = 1) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(steps):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(axis=1))
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def robust_prune(x: np.ndarray, node: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each node of `node` at most `degree` of its candidates (-1 fills): a candidate goes when one nearer to the node
    is alpha times nearer to it than the node is."""
    sims = np.einsum("nd,ncd->nc", x[node], x[cand])
    sims[cand == node[:, None]] = -2
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    alive = sims > -2
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    far = np.sqrt(np.maximum(0, 2 - 2 * sims))
    vectors = x[cand]
    out = np.full((len(node), degree), -1, dtype=np.int64)
    used = np.zeros(len(node), dtype=np.int64)
    for c in range(cand.shape[1]):
        take = np.flatnonzero(alive[:, c] & (used < degree))
        if not len(take):
            continue
        out[take, used[take]] = cand[take, c]
        used[take] += 1
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,ncd->nc", vectors[take, c], vectors[take])))
        alive[take] &= ~(alpha * between < far[take])
    return out


def build_graph(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Adjacency (n, 2 * DEGREE) of unit vectors, filled with -1: pruned candidates and reverse edges."""
    n, rng = len(x), np.random.default_rng(seed)
    kept, step = [], max(16, min(BATCH, CELLS // ((NEAR + RANDOM) * x.shape[1])))
    for lo in range(0, n, step):
        node = np.arange(lo, min(n, lo + step))
        sims = x[node] @ x.T
        sims[np.arange(len(node)), node] = -2
        k = min(NEAR, n - 1)
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(node), 0), np.int64)
        cand = np.concatenate([near, rng.integers(0, n, size=(len(node), RANDOM))], axis=1)
        kept.append(robust_prune(x, node, cand))
    near = np.concatenate(kept)
    a, slot = np.nonzero(near >= 0)
    b = near[a, slot]
    return unite(n, np.concatenate([a, b]), np.concatenate([b, a]), x, 2 * DEGREE)


def unite(n: int, a: np.ndarray, b: np.ndarray, x: np.ndarray | None, width: int) -> np.ndarray:
    """Adjacency from edges, without repeats; beyond width, the nearest stay."""
    code = np.unique(a * n + b)
    a, b = code // n, code % n
    if x is not None:
        order = np.lexsort((-pair_sims(x, a, x, b), a))
        a, b = a[order], b[order]
    begin = np.searchsorted(a, np.arange(n))
    slot = np.arange(len(a)) - begin[a]
    width = min(width, int(slot.max()) + 1) if len(a) else 1
    out = np.full((n, width), -1, dtype=np.int64)
    ok = slot < width
    out[a[ok], slot[ok]] = b[ok]
    return out


def medoids(x: np.ndarray, k: int = MEDOIDS) -> np.ndarray:
    """The nodes nearest to the centres of k clusters of the shard."""
    return np.unique(np.argmax(fit_centroids(x[:: max(1, len(x) // 2000)], k, 4) @ x.T, axis=1))


def range_search(x: np.ndarray, adj: np.ndarray, query: np.ndarray, starts: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (query node, found node) of similarity of about `least` or more, per batch of queries, and their similarities."""
    n = len(x)
    for lo in range(0, len(query), BATCH):
        q = query[lo : lo + BATCH]
        rows, v = np.arange(len(q)), x[q]
        seen = np.zeros((len(q), n), dtype=bool)
        sims = np.full((len(q), n), -2.0, dtype=np.float32)
        beam = np.concatenate([np.tile(starts, (len(q), 1)), q[:, None]], axis=1)
        np.put_along_axis(seen, beam, True, 1)
        score = pair_sims(v, np.repeat(rows, beam.shape[1]), x, beam.ravel()).reshape(beam.shape)
        np.put_along_axis(sims, beam, score.astype(np.float32), 1)
        fresh = np.ones_like(beam, dtype=bool)
        while True:
            # Greedy: expand each query's best node that is not expanded yet, keep the BEAM best.
            best = np.argmax(np.where(fresh, score, -3), axis=1)
            open_ = fresh[rows, best]
            if not open_.any():
                break
            fresh[rows, best] = False
            r = rows[open_]
            near = adj[beam[r, best[r]]]
            new = (near >= 0) & ~seen[r[:, None], near]
            rr, cc = np.nonzero(new)
            seen[r[rr], near[rr, cc]] = True
            got = np.full(near.shape, -3.0)
            got[rr, cc] = pair_sims(v, r[rr], x, near[rr, cc])
            sims[r[rr], near[rr, cc]] = got[rr, cc]
            w, wide = beam.shape[1], beam.shape[1] + near.shape[1]
            all_id, all_s, all_f = np.zeros((len(q), wide), np.int64), np.full((len(q), wide), -3.0), np.zeros((len(q), wide), bool)
            all_id[:, :w], all_s[:, :w], all_f[:, :w] = beam, score, fresh
            all_id[r, w:], all_s[r, w:], all_f[r, w:] = np.maximum(near, 0), got, new
            top = np.argpartition(-all_s, BEAM - 1, axis=1)[:, :BEAM] if wide > BEAM else np.tile(np.arange(wide), (len(q), 1))
            beam, score, fresh = np.take_along_axis(all_id, top, 1), np.take_along_axis(all_s, top, 1), np.take_along_axis(all_f, top, 1)
            fresh &= score > -3
        # Range expansion: every node near the range is expanded until none is new.
        rr, cc = np.nonzero(sims >= least - SLACK)
        while len(rr):
            # Queries with more neighbours to look at than the shard has vectors are measured against all of it.
            dense = np.flatnonzero(np.bincount(rr, minlength=len(q)) * adj.shape[1] > n)
            if len(dense):
                sims[dense], seen[dense] = v[dense] @ x.T, True
                rest = ~np.isin(rr, dense)
                rr, cc = rr[rest], cc[rest]
            grown = []
            for k in range(0, len(rr), FRONTIER):
                near = adj[cc[k : k + FRONTIER]]
                mine = rr[k : k + FRONTIER]
                at, slot = np.nonzero((near >= 0) & ~seen[mine[:, None], near])
                code = np.unique(mine[at] * n + near[at, slot])
                r, c = code // n, code % n
                seen[r, c] = True
                s = pair_sims(v, r, x, c)
                sims[r, c] = s
                more = s >= least - SLACK
                grown.append((r[more], c[more]))
            rr, cc = (np.concatenate(z) for z in zip(*grown, strict=True)) if grown else (rr[:0], cc[:0])
        r, c = np.nonzero(sims >= least - 1e-5)
        other = q[r] != c
        yield q[r][other], c[other], sims[r, c][other]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, dim, vec (the doubles' bytes; null for a vector that cannot link) of every row."""
    for batch in batches:
        column = batch.column(1)
        size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        blobs = np.full(len(batch), None, dtype=object)
        for dim in np.unique(size[size > 0]):
            at = np.flatnonzero(size == dim)
            x = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            with np.errstate(all="ignore"):
                whole = (x * x).sum(axis=1)
            for k in np.flatnonzero(np.isfinite(x).all(axis=1) & np.isfinite(whole) & (whole > 0)):
                blobs[at[k]] = x[k].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), pa.array(blobs, pa.binary())], ["id", "dim", "vec"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), dtype=np.float64).reshape(len(blobs), -1)


def _dealt(centres: np.ndarray, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sims = unit(_matrix(batch.column(batch.schema.get_field_index("vec")))) @ centres.T
            top = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(top.astype(np.int64)), pa.list_(pa.int64()))], [*batch.schema.names, "shards"])

    return run


def _fine_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per large shard, the centroids of its sample (`fine` of them), as doubles' bytes."""
    for table in groups(batches, "shard"):
        c = fit_centroids(unit(_matrix(table["vec"])), table["fine"][0].as_py())
        yield pa.RecordBatch.from_arrays([pa.array([table["shard"][0].as_py()], pa.int64()), pa.array([c.tobytes()], pa.binary())], ["shard", "centres"])


def _dealt_finer(overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each part of a large shard, led by the row with its centroids: node, shard, and the finer shards of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "part"):
            vec = table["vec"].combine_chunks()
            dim = len(vec.drop_null()[0].as_py()) // 8 if vec.null_count < len(vec) else 0
            if not dim:
                continue
            head = table["centres"].combine_chunks().drop_null()
            if not len(head):
                continue
            centres = np.frombuffer(head[0].as_py(), dtype=np.float64).reshape(-1, dim)
            mine = table.filter(pc.is_valid(table["vec"]))
            shard = mine["shard"][0].as_py()
            ids = mixed(np.arange(1, len(centres) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(shard % (1 << 64))).view(np.int64)
            top = np.argsort(-(unit(_matrix(mine["vec"])) @ centres.T), axis=1, kind="stable")[:, :overlap]
            yield pa.RecordBatch.from_arrays([mine["node"].combine_chunks(), mine["shard"].combine_chunks(), pa.array(list(ids[top]), pa.list_(pa.int64()))], ["node", "shard", "finer"])

    return run


def finer(dealt: DataFrame, overlap: int, width: int, levels: int) -> DataFrame:
    """dealt with every shard above SPLIT vectors replaced by finer ones, level by level.

    A large shard is fitted on about SHARD_SAMPLE of its vectors, chosen by a hash, and dealt in parts that each carry the
    centroids, so no task holds a large shard and nothing is broadcast. A node goes to the `overlap` nearest finer shards
    of its home and to half as many of each other large shard that it was in; the nearest one in its home is its new home.
    """
    for level in range(levels):
        members = dealt.select("node", "vec", F.explode("shards").alias("shard"))
        large = settle(members.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT), "graph-large")
        if large.isEmpty():
            break
        inside = members.join(large, "shard").withColumn("parts", F.ceil(F.col("n") / BLOCK))
        chance = F.pmod(F.xxhash64("node", F.lit(level + 21)), F.lit(1 << 30)) / float(1 << 30)
        fine = F.least(F.lit(MOST_SHARDS), F.greatest(F.lit(2), F.col("n") / PER_SHARD)).cast("int")
        sample = inside.where(chance < SHARD_SAMPLE / F.col("n")).select("shard", fine.alias("fine"), "node", "vec")
        centres = settle(sample.repartition(width, "shard").sortWithinPartitions("shard", "node").mapInArrow(_fine_centres, "shard long, centres binary"), "graph-centres")
        slot = F.pmod(F.xxhash64("node", F.lit(level + 51)), F.col("parts"))
        rows = inside.select(F.xxhash64("shard", slot).alias("part"), "shard", "node", "vec", F.lit(None).cast("binary").alias("centres"))
        heads = centres.join(large, "shard").withColumn("slot", F.explode(F.expr(f"sequence(0L, ceil(n / {BLOCK}) - 1)"))).select(F.xxhash64("shard", "slot").alias("part"), "shard", F.lit(None).cast("long").alias("node"), F.lit(None).cast("binary").alias("vec"), "centres")
        told = rows.union(heads).repartition(width, "part").sortWithinPartitions("part", "node").mapInArrow(_dealt_finer(overlap), "node long, shard long, finer array<long>")
        told = settle(told, "graph-finer").groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("shard", "finer"))).alias("_finer"))
        many = lambda place: F.when(place == 0, overlap).otherwise(max(2, overlap // 2))
        wide = F.flatten(F.transform("shards", lambda s, place: F.coalesce(F.slice(F.try_element_at("_finer", s), F.lit(1), many(place)), F.array(s))))
        dealt = settle(dealt.join(told, "node", "left").withColumn("shards", F.when(F.col("_finer").isNull(), F.col("shards")).otherwise(wide)).drop("_finer"), "graph-dealt")
    return dealt


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the adjacency of its nodes: the low 32 bits of node keys. Where two keys share them an edge goes astray."""
    for table in groups(batches, "task"):
        node = table["node"].combine_chunks().to_numpy()
        x = unit(_matrix(table["vec"]))
        adj = build_graph(x)
        short = node.astype(np.int32)
        lists = [short[a[a >= 0]] for a in adj]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(lists, pa.list_(pa.int32()))], ["node", "near"])


def _search(link: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: links (numbers of linked vectors), others (the same without their copies) and root of every node with links."""

    def one(table: pa.Table) -> pa.RecordBatch | None:
        take = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
        node, rep, copies, side, home = take("node"), take("rep"), take("copies"), take("side"), take("home")
        raw = _matrix(table["vec"])
        size = np.sqrt((raw * raw).sum(axis=1))
        x = raw / size[:, None]
        n, shard, cross = len(node), table["shard"][0].as_py(), table["i"][0].as_py() != table["j"][0].as_py()
        if n < 2:
            return None
        lists = table["near"].combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        short = node.astype(np.int32)
        order = np.argsort(short, kind="stable")
        at = np.minimum(np.searchsorted(short[order], flat), n - 1)
        here = short[order][at] == flat
        a, b = owner[here], order[at][here]
        adj = unite(n, np.concatenate([a, b]), np.concatenate([b, a]), x, 8 * DEGREE)
        # Which of the vectors each other home's shard holds: a pair with two homes is counted in the lower one, unless
        # only the other holds both.
        homes, own_home = np.unique(home, return_inverse=True)
        dealt = table["shards"].combine_chunks()
        inside = np.zeros((len(homes), n), dtype=bool)
        member = np.repeat(np.arange(n), np.diff(dealt.offsets.to_numpy()))
        where = np.minimum(np.searchsorted(homes, dealt.flatten().to_numpy(zero_copy_only=False)), len(homes) - 1)
        real = homes[where] == dealt.flatten().to_numpy(zero_copy_only=False)
        inside[where[real], member[real]] = True
        hit = np.zeros((n, n), dtype=bool)
        for q, c, sims in range_search(x, adj, np.flatnonzero(home == shard), medoids(x), link):
            other = own_home[c]
            ok = ~((homes[other] < shard) & inside[other, q] & inside[other, c])
            if cross:
                ok &= side[q] != side[c]
            unsure = np.flatnonzero(ok & (sims < link + 1e-5))
            ok[unsure] = pair_sims(raw, q[unsure], raw, c[unsure]) / (size[q[unsure]] * size[c[unsure]]) >= link
            hit[np.minimum(q, c)[ok], np.maximum(q, c)[ok]] = True
        links, others, low = np.zeros(n), np.zeros(n, np.int64), np.arange(n)
        order = np.lexsort((node, rep))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        for lo in range(0, n, BATCH):
            a, b = np.nonzero(hit[lo : lo + BATCH])
            a += lo
            links += np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)
            others += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            code = np.unique(low[rank[a]] * n + low[rank[b]])
            low = forest(n, code // n, code % n)[low]
        has = others > 0
        if not has.any():
            return None
        root = rep[order][low][rank]
        return pa.RecordBatch.from_arrays([pa.array(v[has]) for v in (node, rep, links.astype(np.int64), others, root)], ["node", "rep", "links", "others", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "task"):
            out = one(table)
            if out is not None:
                yield out

    return run


def _counted(x: np.ndarray, link: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Brute force for the audit: per batch, how many different vectors each audited one links with (itself included)."""
    size = np.sqrt((x * x).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            y = _matrix(batch.column(0))
            hit = (x @ y.T) / (size[:, None] * np.sqrt((y * y).sum(axis=1))[None, :]) >= link
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int64)), pa.array(hit.sum(axis=1))], ["k", "n"])

    return run


def _tasks(dealt: DataFrame, shard: str) -> DataFrame:
    """A row per node and task of a shard: one task, or pairs of blocks where the shard is above BLOCK."""
    sizes = dealt.groupBy(shard).agg(F.count(F.lit(1)).alias("_n")).select(F.col(shard), F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    each = dealt.join(sizes, shard).withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return each.withColumn("i", i).withColumn("j", j).withColumn("side", F.when(F.col("block") == i, 0).otherwise(1)).withColumn("task", F.xxhash64(shard, "i", "j")).drop("block", "other", "blocks")


def near_vectors(table: DataFrame, link: float = 0.95, key: str = "vec_id", vector: str = "embedding", overlap: int = 4, recall: float = 0.9, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_recall of every row (the audit of the vectors of its length)."""
    rows = table.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vector).alias("v"))
    parsed = settle(small_batches(rows).mapInArrow(_parsed, "id long, dim long, vec binary"), "graph-parsed")
    blank = F.lit(None).cast("double")
    out = parsed.where("vec is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("comp"), blank.alias("told"))
    for (dim,) in sorted(parsed.where("vec is not null").select("dim").distinct().collect()):
        out = out.union(_of_length(parsed.where((F.col("dim") == dim) & F.col("vec").isNotNull()).select("id", "vec"), link, overlap, recall, sample))
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(real(F.col("id")).alias("vec_id"), F.col("links").cast("long").alias("n_links"), real(F.col("comp")).alias("component_id"), (F.col("id") == F.col("comp")).alias("kept"), F.col("told").alias("audited_recall"))


def _of_length(parsed: DataFrame, link: float, overlap: int, recall: float, sample: int) -> DataFrame:
    """id, links, comp, told of vectors (id, vec) of one length."""
    classes = parsed.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.xxhash64("rep", "vec"))
    classes = settle(classes, "graph-classes")
    total = classes.count()
    fit_on = classes.orderBy(F.xxhash64("node"), "node").limit(sample).select("vec").toPandas()["vec"]
    centres = fit_centroids(unit(np.frombuffer(b"".join(fit_on), dtype=np.float64).reshape(len(fit_on), -1)), max(1, min(MOST_SHARDS, total // PER_SHARD)))
    width = max(2, shuffle_width(parsed.sparkSession))
    levels = LEVELS
    while True:
        found = settle(_linked(classes, centres, min(overlap, len(centres)), link, width, levels), "graph-links")
        links = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))
        known = settle(classes.select("node", "rep", "vec", "copies").join(links, "node", "left").select("node", "rep", "vec", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("others", F.lit(0)).alias("others")), "graph-known")
        told = audit(known, classes, link)
        if told >= recall or (overlap >= len(centres) and not levels):
            break
        # Dense groups lose links between finer shards: the next search keeps shards whole, later ones overlap more.
        overlap, levels = overlap if levels else overlap * 2, 0
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "graph-components")
    known = known.join(parts, F.col("rep") == parts["node"], "left").select("vec", "links", F.coalesce("comp", "rep").alias("comp"))
    return parsed.join(known, "vec").select("id", "links", "comp", F.lit(told).alias("told"))


def _linked(classes: DataFrame, centres: np.ndarray, overlap: int, link: float, width: int, levels: int) -> DataFrame:
    dealt = settle(classes.mapInArrow(_dealt(centres, overlap), wider(classes.schema, ("shards", ArrayType(LONG)))), "graph-dealt")
    dealt = finer(dealt, overlap, width, levels)
    members = dealt.withColumn("home", F.element_at("shards", 1)).withColumn("shard", F.explode("shards"))
    tasks = _tasks(members, "shard")
    built = tasks.select("task", "node", "vec").repartition(width, "task").sortWithinPartitions("task", "node").mapInArrow(_build, "node long, near array<int>")
    lists = settle(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph-adjacency")
    whole = tasks.join(lists, "node", "left").select("task", "i", "j", F.col("side").cast("long").alias("side"), F.col("shard").cast("long").alias("shard"), F.col("home").cast("long").alias("home"), "shards", "node", "rep", "copies", "vec", F.coalesce("near", F.expr("cast(array() as array<int>)")).alias("near"))
    return whole.repartition(width, "task").sortWithinPartitions("task", "node").mapInArrow(_search(link), "node long, rep long, links long, others long, root long")


def audit(known: DataFrame, classes: DataFrame, link: float) -> float:
    """Recall of the links between different vectors; 1 where there are none.

    AUDITED vectors with such links found and AUDITED without are compared with brute force and stand for all of their
    kind. The lower counts: links found over links that exist, or the mean of that over the vectors that have any.
    """
    kinds = {r.some: r.n for r in known.groupBy((F.col("others") > 0).alias("some")).agg(F.count(F.lit(1)).alias("n")).collect()}
    order = (F.xxhash64("node", F.lit(11)), "node")
    rows = known.where("others > 0").orderBy(*order).limit(AUDITED).union(known.where("others = 0").orderBy(*order).limit(AUDITED)).select("vec", "others").collect()
    if not rows:
        return 1.0
    x = np.frombuffer(b"".join(bytes(r.vec) for r in rows), dtype=np.float64).reshape(len(rows), -1)
    true = classes.select("vec").mapInArrow(_counted(x, link), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    exist = np.zeros(len(rows))
    for r in true:
        exist[r.k] = max(0, r.n - 1)
    had = np.array([r.others for r in rows])
    some, got = had > 0, np.minimum(had, exist)
    weight = np.where(some, kinds.get(True, 0) / max(1, some.sum()), kinds.get(False, 0) / max(1, (~some).sum())) * (exist > 0)
    if not weight.any():
        return 1.0
    return float(min((weight * got).sum() / (weight * exist).sum(), (weight * got / np.maximum(exist, 1)).sum() / weight.sum()))
