"""N-gram Jaccard join by MinHash banding.

Documents are sets of word n-grams. Those with equal sets form a class at once; classes are compared by MinHash bands
whose number and width follow from the wanted recall at the threshold. Band hashes are shuffled, and every pair of
classes that meets in a bucket is verified on the full n-gram sets, recomputed from the whole texts.

A pair is verified once, in the first bucket that both share. Buckets with the same members are verified once, and
large ones in pairs of blocks, so no task holds a hot bucket. Links are counted where they are found and only a
spanning forest of each bucket's links leaves the task: no pair is ever a row, and none is lost.

Every class is a node of its own and stands for its rows by one of their texts, found again by id and text hash, so
rows that share an id (null included) cost and link no more than others.

Defined cases: words are runs of anything but ASCII white space, compared as they are; a text of fewer than n words is
one n-gram of all its words; texts without a word (null, empty, blank) link with nothing, themselves included; rows that
share an id are rows of their own, which may be in different classes and components; the smallest id of a class or
component is that of its rows with an id, null where none has one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.bytesx import chunks, distinct, groups, mixed, shingle_hashes, strings
from lakequill.llm.common import components, marked, may_hold, release, settle, shuffle_width, small_batches

NO_ID = -(1 << 63)
#: Texts in one verification block: at most about so many rows or bytes.
BLOCK_ROWS, BLOCK_BYTES = 512, 12 << 20


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows per band: the widest bands that reach the recall at the threshold with at most `most` hashes."""
    for rows in range(16, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding reaches the recall")


def set_digest(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set of distinct hashes (0, 0 for an empty set)."""
    zero = np.zeros(1, np.uint64)
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([zero, np.cumsum(mixed(hashes ^ np.uint64(salt)))])
        out.append(np.where(np.diff(starts) > 0, mixed((total[starts[1:]] - total[starts[:-1]]) + np.diff(starts).astype(np.uint64)), np.uint64(0)).view(np.int64))
    return out[0], out[1]


def minhash_bands(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A (texts, bands) table of band hashes; rows of empty sets are 0."""
    n, full = len(starts) - 1, np.diff(starts) > 0
    out = np.zeros((n, bands), dtype=np.uint64)
    if not full.any():
        return out.view(np.int64)
    begin = starts[:-1][full]
    seeds = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    v = np.empty_like(hashes)
    for b in range(bands):
        band = np.full(full.sum(), b + 1, dtype=np.uint64)
        for r in range(rows):
            k = b * rows + r
            np.bitwise_xor(hashes, seeds[2 * k], out=v)
            np.multiply(v, seeds[2 * k + 1] | np.uint64(1), out=v)
            band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, begin))
        out[full, b] = band
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """id (null as NO_ID), text_hash, d1, d2 (digest of the n-gram set), n_grams, bytes, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(2))
            for lo, hi in chunks(offsets, 1 << 20):
                begin, end = offsets[lo], offsets[hi]
                h, s = distinct(*shingle_hashes(data[begin:end], offsets[lo : hi + 1] - begin, n))
                d1, d2 = set_digest(h, s)
                table = minhash_bands(h, s, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(table.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(d1), pa.array(d2), pa.array(np.diff(s)), pa.array(np.diff(offsets[lo : hi + 1])), lists], ["id", "text_hash", "d1", "d2", "n_grams", "bytes", "bands"])

    return small_batches(_texts(docs)).mapInArrow(run, "id long, text_hash long, d1 long, d2 long, n_grams long, bytes long, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def _links(h: np.ndarray, starts: np.ndarray, side: np.ndarray, kept: list[np.ndarray], bucket: int, num: int, den: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (a, b) of a task's texts whose first common bucket is this one: a of the first block, b of the second.

    Overlaps are counted through an inverted list from each n-gram to its texts.
    """
    n, size = len(starts) - 1, np.diff(starts)
    row = np.repeat(np.arange(n), size)
    _, gram = np.unique(h, return_inverse=True)
    order = np.argsort(gram, kind="stable")
    posted, where = row[order], np.concatenate([[0], np.cumsum(np.bincount(gram))])
    many = where[1:] - where[:-1]
    found_a, found_b = [], []
    for a in np.flatnonzero(side == 0):
        mine = gram[starts[a] : starts[a + 1]]
        mine = mine[many[mine] > 1]
        if not len(mine):
            continue
        reps = many[mine]
        at = np.repeat(where[mine] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
        common = np.bincount(posted[at], minlength=n)
        ok = (num + den) * common >= num * (size[a] + size)
        ok[: a + 1] &= not same
        ok &= (side == 1) if not same else True
        ok[a] = False
        b = np.flatnonzero(ok & (common > 0))
        earlier = kept[a][kept[a] < bucket]
        if len(b) and len(earlier):
            b = np.array([x for x in b if not np.isin(earlier, kept[x], assume_unique=True).any()], dtype=np.int64)
        found_a.append(np.full(len(b), a))
        found_b.append(b)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a) if found_a else none), (np.concatenate(found_b) if found_b else none)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component under the pairs."""
    low = np.arange(n)
    while len(a):
        now = low.copy()
        np.minimum.at(now, a, low[b])
        np.minimum.at(now, b, low[a])
        now = now[now]
        if (now == low).all():
            break
        low = now
    return low


def _verify(n: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From the texts of tasks, sorted by task: links (number of linked documents) and root of every text with links."""

    def one(table: pa.Table) -> pa.RecordBatch | None:
        data, offsets = strings(table["text"])
        h, s = distinct(*shingle_hashes(data, offsets, n))
        d1, d2 = set_digest(h, s)
        col = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
        # Texts of one id whose hashes collide: the digest tells which one is meant.
        right = np.flatnonzero((d1 == col("d1")) & (d2 == col("d2")))
        right = right[np.unique(col("node")[right], return_index=True)[1]]
        if len(right) < 2:
            return None
        h = np.concatenate([h[s[k] : s[k + 1]] for k in right])
        s = np.concatenate([[0], np.cumsum(np.diff(s)[right])])
        same = table["i"][0].as_py() == table["j"][0].as_py()
        side, node, copies = col("side")[right], col("node")[right], col("copies")[right]
        kept_at = table["kept"].combine_chunks().take(pa.array(right))
        kept = [np.array(k, dtype=np.int64) for k in kept_at.to_pylist()]
        a, b = _links(h, s, side, kept, table["bucket"][0].as_py(), num, den, same)
        if not len(a):
            return None
        links = np.bincount(a, weights=copies[b], minlength=len(node)) + np.bincount(b, weights=copies[a], minlength=len(node))
        root = node[forest(len(node), a, b)]  # nodes are in ascending order
        has = links > 0
        return pa.RecordBatch.from_arrays([pa.array(x[has]) for x in (node, links.astype(np.int64), root)], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "task"):
            out = one(table)
            if out is not None:
                yield out

    return run


def joined_rows(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), recall: float = 0.9995) -> DataFrame:
    """A row per row of docs: id (null as NO_ID), text_hash, node (its class, null without a word), class_id, component_id
    (NO_ID where none of its rows has an id), n_links, and first: the struct (no_id, id, text_hash) of the component's first row."""
    num, den = threshold
    bands, rows = bands_for(num / den, recall)
    signed = settle(signatures(docs, n, bands, rows), "ngram-signatures")
    first = F.struct((F.col("id") == NO_ID).alias("no_id"), "id", "text_hash")
    classes = signed.where("n_grams > 0").groupBy("d1", "d2").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("bytes").alias("bytes"), F.first("bands").alias("bands"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    members = classes.select("node", "bytes", F.posexplode("bands").alias("band", "h"))
    buckets = members.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).cast("decimal(38,0)").alias("f1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("f2"))
    # Of buckets with the same members one stays: the sums of their members' hashes tell.
    uniform = buckets.where("n > 1").groupBy("n", "f1", "f2").agg(F.min(F.struct("band", "h", "total")).alias("b")).select("b.band", "b.h", "n", "b.total")
    uniform = settle(uniform.select("band", "h", "n", "total", F.xxhash64("band", "h").alias("bucket")), "ngram-buckets")
    placed = settle(members.join(uniform, ["band", "h"]).select("node", "bucket", "n", "total"), "ngram-placed")
    kept = placed.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("kept"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_BYTES), F.lit(1)).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    slim = classes.select("node", "d1", "d2", "copies", F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"))
    sided = placed.join(kept, "node").join(slim, "node").withColumn("blocks", blocks).withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    tasks = sided.select(F.xxhash64("bucket", i, j).alias("task"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.when(F.col("block") == i, 0).otherwise(1).cast("int").alias("side"), "bucket", "node", "d1", "d2", "copies", "kept", "id", "text_hash")
    # Only texts of classes that met another one move, and some by chance.
    map_ = settle(may_hold(placed.select("node").distinct().join(slim, "node"), "id"), "ngram-map")
    texts = marked(_texts(docs), "id", map_)
    if not marked(signed, "id", map_).groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        # Whole rows repeat: one of each stays, copies being dropped before they move.
        texts = texts.groupBy("id", "text_hash").agg(F.first("text").alias("text"))
    told = tasks.join(texts, ["id", "text_hash"]).drop("id", "text_hash")
    width = shuffle_width(docs.sparkSession)
    dealt = told.repartition(max(width, 2), "task").sortWithinPartitions("task", "node", "side")
    found = settle(small_batches(dealt).mapInArrow(_verify(n, num, den), "node long, links long, root long"), "ngram-links")
    release(uniform, placed, map_)
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "ngram-components")
    heads = parts.join(classes.select("node", "first"), "node").groupBy("comp").agg(F.min("first").alias("head"))
    linked = parts.join(heads, "comp").select("node", "head")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "d1", "d2", "copies", "first").join(links, "node", "left").join(linked, "node", "left")
    known = settle(known.select("d1", "d2", "node", F.col("first.id").alias("class_id"), F.coalesce("head", "first").alias("first"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "ngram-known")
    release(classes, found)
    return signed.select("id", "text_hash", "d1", "d2").join(known, ["d1", "d2"], "left").select("id", "text_hash", "node", "class_id", F.col("first.id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "first")


def jaccard_join(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), recall: float = 0.9995) -> DataFrame:
    """doc_id, class_id, component_id, n_links of every row of docs.

    threshold is a fraction. class_id is the smallest id with the same n-gram set, component_id the smallest id that
    links reach, n_links the number of other documents at the threshold or above.
    """
    real = lambda c: F.when(c != NO_ID, c)
    out = joined_rows(docs, n, threshold, recall)
    return out.select(real(F.col("id")).alias("doc_id"), real(F.coalesce("class_id", "id")).alias("class_id"), real(F.coalesce("component_id", "id")).alias("component_id"), "n_links")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs of which each group of near-duplicates keeps one: that with the smallest id, then the smallest text
    hash, then the smallest hash of the whole row. Rows with an id go before rows without; texts without a word all stay."""
    found = settle(joined_rows(docs.select("doc_id", "text"), **options).where("node is not null"), "ngram-kept")
    names, own = docs.columns, {c: f"_{k}" for k, c in enumerate(docs.columns)}
    whole = docs.select(*[F.col(f"`{c}`").alias(own[c]) for c in names]).withColumn("_id", F.coalesce(F.col(own["doc_id"]).cast("long"), F.lit(NO_ID))).withColumn("_text", F.xxhash64(F.coalesce(F.col(own["text"]), F.lit(""))))
    pair = [F.col("id").alias("_id"), F.col("text_hash").alias("_text")]
    head = (F.col("first.id") == F.col("id")) & (F.col("first.text_hash") == F.col("text_hash"))
    gone = settle(found.where(~head).select(*pair).distinct(), "ngram-gone")
    # Rows that the map does not mark stay where they are; of the marked ones, id and text decide.
    map_ = settle(may_hold(gone, "_id"), "ngram-map")
    out = marked(whole, "_id", map_, held=False).union(marked(whole, "_id", map_).join(gone, ["_id", "_text"], "left_anti").select(*whole.columns))
    many = settle(found.where(head).groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*pair), "ngram-repeats")
    release(found)
    if not many.isEmpty():
        # Whole rows, but for other columns, repeat.
        rest = out.join(many, ["_id", "_text"], "left_anti").select(*whole.columns)
        row = F.struct(*[F.col(c) for c in own.values()])
        one = out.join(many, ["_id", "_text"], "left_semi").groupBy("_id", "_text").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
        out = rest.select(*own.values()).union(one.select("row.*"))
    return out.select(*[F.col(own[c]).alias(c) for c in names])


__all__ = ["bands_for", "jaccard_join", "joined_rows", "one_of_each"]
