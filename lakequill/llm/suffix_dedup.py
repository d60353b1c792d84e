"""Suffix deduplication: every byte covered by a WINDOW-byte string that also starts earlier goes.

Only suffixes cut to WINDOW bytes matter, and of those only which are equal and which comes first. Suffixes are put in
alphabetical order by stable mergesorts: on their first bytes, then, among those that tie, on the bytes behind what all of a
tie have in common, which a binary search over prefix polynomial hashes finds in logarithmic steps. So equal suffixes stand
together with the earliest first; each is then verified byte by byte against the earliest, against collisions.

No table of all suffixes is made. Texts are packed; each window of a pack chooses the smallest hash among the GRAM-byte
strings it holds as its anchor, so equal windows choose equal anchors. Anchors that occur once anywhere cannot belong
to a repeated window. For the others, what is first in its pack is sent, as runs of bytes, to the bucket of its anchor,
where runs of all packs are sorted; a bit per window comes back. A hot passage is sent once by each pack.

Defined cases: a null text is empty; texts shorter than WINDOW bytes lose nothing; rows with equal ids are ordered by
their pack and place in it; a null id stands before all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.bytesx import INVERSE, chunks, groups, mixed, piece_hash, power, prefix_hash, strings
from lakequill.llm.common import release, settle, shuffle_width, small_batches
from lakequill.llm.ngram_join import NO_ID

WINDOW, GRAM = 100, 32
#: Bytes of text in a pack; a longer text is a pack of its own.
PACK = 2 << 20
#: Bytes of text, of which what repeats across packs may come to one bucket and to one task.
BUCKET, TASK = 32 << 20, 128 << 20
#: Windows whose anchors are found at a time; their places fit in the low bits below.
STEP, LOW = 1 << 18, np.uint64((1 << 21) - 1)
#: Windows that are sorted, or verified, at a time, about: what is held beside the text follows this, not the pack.
PART = 1 << 18


def _spread(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[k], values[k] + 1, ... , counts[k] of them, for every k."""
    total = int(counts.sum())
    out = np.arange(total)
    out += np.repeat(values - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if total else 0
    return out


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of data one behind the other; few of their places are held at a time."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(ends[-1]), dtype=data.dtype)
    for lo, hi in chunks(ends, PART):
        out[ends[lo] : ends[hi]] = data[_spread(starts[lo:hi], sizes[lo:hi])]
    return out


def anchors(prefix: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of valid windows with one anchor: first window, number of windows, hash of the anchor."""
    n, wide = len(valid), WINDOW - GRAM + 1
    begins, counts, places = [], [], []
    for c in range(0, n, STEP):
        many = min(STEP, n - c)
        top = min(c + many + wide - 1, n - GRAM + 1)
        if top - c < wide:
            break
        at = np.arange(c, top)
        low = mixed(piece_hash(prefix, at, at + GRAM)) & ~LOW | (at - c).astype(np.uint64)
        span = 1
        while span * 2 <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])[:many]
        ok = np.flatnonzero(valid[c : c + len(low)])
        if not len(ok):
            continue
        place = (low[ok] & LOW).astype(np.int64) + c
        new = np.ones(len(ok), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1] + 1)
        first = np.flatnonzero(new)
        begins.append(ok[first] + c)
        counts.append(np.diff(np.concatenate([first, [len(ok)]])))
        places.append(place[first])
    if not begins:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    place = np.concatenate(places)
    return np.concatenate(begins), np.concatenate(counts), mixed(piece_hash(prefix, place, place + GRAM) + np.uint64(1))


def common(prefix: np.ndarray, p: np.ndarray, q: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How far the windows at p and q agree, at least `least`: a binary search on the hashes of what they begin with."""
    hp, hq, ip, iq = prefix[p], prefix[q], power(INVERSE, p), power(INVERSE, q)
    # Most that agree further agree to their end.
    whole = (prefix[p + WINDOW] - hp) * ip == (prefix[q + WINDOW] - hq) * iq
    low, high = np.where(whole, WINDOW, least), np.full(len(p), WINDOW, np.int64)
    high[~whole] -= 1
    while (todo := np.flatnonzero(low < high)).size:
        mid = (low[todo] + high[todo] + 1) // 2
        same = (prefix[p[todo] + mid] - hp[todo]) * ip[todo] == (prefix[q[todo] + mid] - hq[todo]) * iq[todo]
        low[todo], high[todo] = np.where(same, mid, low[todo]), np.where(same, high[todo], mid - 1)
    return low


def alphabetical(data: np.ndarray, prefix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order of the windows at `at` (ascending) by their bytes, equal ones by place."""
    n = len(at)
    data = np.ascontiguousarray(data)
    # The 8 bytes at every place as a number that sorts like them. Near a window's end, those at its end: what they hold
    # of bytes before is the same in all of a tie.
    wide = np.ndarray(max(0, len(data) - 7), dtype=">u8", buffer=data, strides=(1,)) if len(data) > 7 else np.zeros(0, ">u8")
    letters = lambda p, depth: wide[p + np.minimum(depth, WINDOW - 8)].astype(np.uint64)
    key = letters(at, 0)
    order = np.argsort(key, kind="stable")
    tied = np.zeros(n + 1, dtype=bool)
    key = key[order]
    tied[1:-1] = key[1:] == key[:-1]
    # Places in the order that tie with a neighbour, the tie of each, and what all of a tie are known to share.
    spot = np.flatnonzero(tied[1:] | tied[:-1])
    begins = ~tied[spot]
    tie, depth = np.cumsum(begins) - 1, np.full(int(begins.sum()), 8, np.int64)
    while len(spot):
        p = at[order[spot]]
        key = letters(p, depth[tie])
        inner = np.flatnonzero(tie[1:] == tie[:-1])
        parted = np.zeros(len(depth), dtype=bool)
        parted[tie[inner[key[inner] != key[inner + 1]]]] = True
        # Ties that the next bytes do not part are looked at further on, where their nearest two part; or nowhere.
        inner = inner[~parted[tie[inner]]]
        share = np.where(parted, depth, WINDOW)
        for lo in range(0, len(inner), PART):
            k = inner[lo : lo + PART]
            np.minimum.at(share, tie[k], common(prefix, p[k], p[k + 1], depth[tie[k]]))
        rest = share[tie] < WINDOW
        if not rest.any():
            break
        spot, tie, p, key, late = spot[rest], tie[rest], p[rest], key[rest], ~parted[tie[rest]]
        key[late] = letters(p[late], share[tie[late]])
        moved = np.lexsort((key, tie))
        order[spot] = order[spot][moved]
        key, tie = key[moved], tie[moved]
        same = np.zeros(len(spot) + 1, dtype=bool)
        same[1:-1] = (tie[1:] == tie[:-1]) & (key[1:] == key[:-1])
        keep = same[1:] | same[:-1]
        begins = ~same[:-1][keep]
        spot, old = spot[keep], tie[keep]
        tie = np.cumsum(begins) - 1
        depth = np.minimum(share[old[begins]] + 8, WINDOW)
    return order


def _parts(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The windows at `at` (places in `at`, ascending) by ranges of their first byte, of about PART windows or one byte value."""
    begins = data[at]
    part, room = np.zeros(256, dtype=np.uint8), 0
    for byte, many in enumerate(np.bincount(begins, minlength=256).tolist()):
        new = byte > 0 and room + many > PART
        room = many if new else room + many
        part[byte] = part[byte - 1] + new if byte else 0
    of = part[begins]
    for k in range(int(part[-1]) + 1):
        yield np.flatnonzero(of == k)


def _firsts(data: np.ndarray, prefix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each window the place in `at` of the first that equals it: they stand together in alphabetical order."""
    first = np.empty(len(at), dtype=np.int64)
    for part in _parts(data, at):
        if len(part):
            own = at[part]
            order = alphabetical(data, prefix, own)
            h = piece_hash(prefix, own[order], own[order] + WINDOW)
            new = np.ones(len(part), dtype=bool)
            new[1:] = h[1:] != h[:-1]
            first[part[order]] = part[order[np.maximum.accumulate(np.where(new, np.arange(len(part)), 0))]]
    return first


def _verified(data: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the windows at p and q agree, and which were judged by their last byte only: those whose left neighbours are
    a pair as well."""
    follows, equal = np.zeros(len(p), dtype=bool), np.zeros(len(p), dtype=bool)
    for lo in range(0, len(p), PART):
        here, before = slice(max(lo, 1), lo + PART), slice(max(lo, 1) - 1, min(lo + PART, len(p)) - 1)
        follows[here] = (p[here] == p[before] + 1) & (q[here] == q[before] + 1)
        here = slice(lo, lo + PART)
        equal[here] = data[p[here] + WINDOW - 1] == data[q[here] + WINDOW - 1]
    whole, span = np.flatnonzero(~follows), np.arange(WINDOW)
    for lo in range(0, len(whole), 20_000):
        k = whole[lo : lo + 20_000]
        equal[k] = (data[p[k][:, None] + span] == data[q[k][:, None] + span]).all(axis=1)
    return equal, follows


def repeated(data: np.ndarray, prefix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the windows at `at`, given in order of precedence and place, equal an earlier one.

    The sort brings equal windows together. A window whose left neighbour repeats the left neighbour of the same earlier window needs one byte
    compared, others all.
    """
    n = len(at)
    if not n:
        return np.zeros(0, dtype=bool)
    first = _firsts(data, prefix, at)
    dup = first != np.arange(n)
    p, q = at[dup], at[first[dup]]
    del first
    equal, follows = _verified(data, p, q)
    if not equal.all():
        # What follows an unequal pair was judged by one byte only.
        bad = np.cumsum(~equal)
        begin = np.flatnonzero(~follows)
        before = (bad - ~equal)[begin][np.cumsum(~follows) - 1]
        equal &= bad == before
        # Hashes have collided: windows with such a hash are compared by their bytes alone.
        h = piece_hash(prefix, at, at + WINDOW)
        for value in np.unique(h[dup][~equal]):
            seen: set[bytes] = set()
            for k in np.flatnonzero(h == value):
                text = data[at[k] : at[k] + WINDOW].tobytes()
                dup[k] = text in seen
                seen.add(text)
    return dup


def packs(docs: DataFrame, pack: int = PACK) -> DataFrame:
    """pack, ids, sizes, blob: texts in ascending order of ids, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, press = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = strings(batch.column(1))
            for lo, hi in chunks(offsets, pack):
                sizes = np.diff(offsets[lo : hi + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([ids[lo:hi]], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([press.compress(data[offsets[lo] : offsets[hi]].tobytes())], pa.binary())],
                    ["pack", "ids", "sizes", "blob"],
                )
                number += 1

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text"))
    return small_batches(rows).mapInArrow(run, "pack long, ids array<long>, sizes array<long>, blob binary")


class _Pack:
    """A pack's texts with the runs of windows and their anchors."""

    def __init__(self, row: dict):
        self.pack, self.ids, self.sizes = row["pack"], np.array(row["ids"], dtype=np.int64), np.array(row["sizes"], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"]), dtype=np.uint8)

    def find(self, buckets: int) -> None:
        valid = np.ones(len(self.data), dtype=bool)
        for size, end in zip(self.sizes, self.ends, strict=True):
            valid[max(end - size, end - WINDOW + 1) : end] = False
        self.prefix = prefix_hash(self.data)
        self.begin, self.count, self.anchor = anchors(self.prefix, valid)
        bucket = (self.anchor % np.uint64(buckets)).astype(np.int64)
        self.unique, first, self.which, times = np.unique(self.anchor, return_index=True, return_inverse=True, return_counts=True)
        self.bucket, self.many = bucket[first], times > 1

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each bucket, the places in `unique` of its anchors."""
        order = np.argsort(self.bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(self.bucket[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                yield int(self.bucket[part[0]]), part


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]


def _send_anchors(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            own = _Pack(row)
            own.find(buckets)
            sent = [(b, own.unique[part].tobytes()) for b, part in own.by_bucket()]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in sent], pa.int64()), pa.array([own.pack] * len(sent), pa.int64()), pa.array([x for _, x in sent], pa.binary())], ["bucket", "pack", "hashes"])

    return run


def _meet_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pack and bucket, a bit per anchor: does another pack hold it?"""
    for table in groups(batches, "bucket"):
        blobs = table["hashes"].to_pylist()
        sizes = np.array([len(b) // 8 for b in blobs])
        h = np.frombuffer(b"".join(blobs), dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        met = np.zeros(len(h), dtype=bool)
        met[order[1:][same]] = True
        met[order[:-1][same]] = True
        out = [(p, np.packbits(m).tobytes()) for p, m in zip(table["pack"].to_pylist(), np.split(met, np.cumsum(sizes)[:-1]), strict=True) if m.any()]
        bucket = table["bucket"][0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([bucket] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())], ["pack", "bucket", "bits"])


#: One run of windows as it is sent: document, first byte in the document, first byte in the pack, windows.
_RUN = np.dtype([("id", "<i8"), ("pos", "<i8"), ("at", "<i4"), ("n", "<i4")])


def _send_runs(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows per bucket: runs and their bytes. The row of bucket -1 holds the windows that repeat within the pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for row in _rows(batches):
            own = _Pack(row)
            own.find(buckets)
            met = np.zeros(len(own.unique), dtype=bool)
            flags = {f["bucket"]: f["bits"] for f in row["flags"] or []}
            for b, part in own.by_bucket():
                if b in flags:
                    met[part] = np.unpackbits(np.frombuffer(flags[b], dtype=np.uint8), count=len(part)).astype(bool)
            runs = np.flatnonzero((met | own.many)[own.which])
            # Runs are in the order of their windows, none of which is in two.
            window, count = _spread(own.begin[runs], own.count[runs]), own.count[runs]
            dup = repeated(own.data, own.prefix, window)
            gone = np.zeros(len(own.data), dtype=bool)
            gone[window[dup]] = True
            out = [(-1, b"", press.compress(np.packbits(gone).tobytes()))]
            ask = ~dup & np.repeat(met[own.which[runs]], count)
            w, o = window[ask], np.repeat(runs, count)[ask]
            new = np.ones(len(w), dtype=bool)
            new[1:] = (w[1:] != w[:-1] + 1) | (o[1:] != o[:-1])
            first = np.flatnonzero(new)
            told = np.zeros(len(first), dtype=_RUN)
            told["at"], told["n"] = w[first], np.diff(np.concatenate([first, [len(w)]]))
            doc = np.searchsorted(own.ends, told["at"], side="right")
            told["id"], told["pos"] = own.ids[doc], told["at"] - (own.ends - own.sizes)[doc]
            bucket = own.bucket[own.which[o[first]]]
            for b in np.unique(bucket):
                part = told[bucket == b]
                text = own.data[_spread(part["at"].astype(np.int64), part["n"].astype(np.int64) + WINDOW - 1)]
                out.append((int(b), part.tobytes(), press.compress(text.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([own.pack] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "pack", "runs", "blob"])

    return run


def _meet_runs() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each pack and bucket, a bit per window that was sent: does another pack have it earlier?"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for table in groups(batches, "bucket"):
            sent = [np.frombuffer(b, dtype=_RUN) for b in table["runs"].to_pylist()]
            runs = np.concatenate(sent)
            data = np.frombuffer(b"".join(opener.decompress(b) for b in table["blob"].to_pylist()), dtype=np.uint8)
            pack = np.repeat(np.arange(len(sent)), [len(s) for s in sent])
            key = table["pack"].combine_chunks().to_numpy(zero_copy_only=False)
            size = runs["n"].astype(np.int64) + WINDOW - 1
            start = np.cumsum(size) - size
            order = np.lexsort((runs["pos"], key[pack], runs["id"]))
            data = _gathered(data, start[order], size[order])
            many = runs["n"].astype(np.int64)
            begin = np.cumsum(size[order]) - size[order]
            late = repeated(data, prefix_hash(data), _spread(begin, many[order]))
            # Back to the order in which the windows were sent.
            back = np.zeros(len(late), dtype=bool)
            back[_spread((np.cumsum(many) - many)[order], many[order])] = late
            ends = np.cumsum(np.bincount(pack, weights=many, minlength=len(sent)).astype(np.int64))
            out = [(int(k), np.packbits(b).tobytes()) for k, b in zip(key, np.split(back, ends[:-1]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([table["bucket"][0].as_py()] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())], ["pack", "bucket", "bits"])

    return run


def _cut(texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows per document, from packs with what came back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for row in _rows(batches):
            own = _Pack(row)
            gone = np.zeros(len(own.data) + WINDOW, dtype=bool)
            for part in row["parts"] or []:
                if part["bucket"] < 0:
                    gone[: len(own.data)] |= np.unpackbits(np.frombuffer(opener.decompress(part["own"]), dtype=np.uint8), count=len(own.data)).astype(bool)
                elif part["bits"] is not None:
                    runs = np.frombuffer(part["runs"], dtype=_RUN)
                    window = _spread(runs["at"].astype(np.int64), runs["n"].astype(np.int64))
                    gone[window[np.unpackbits(np.frombuffer(part["bits"], dtype=np.uint8), count=len(window)).astype(bool)]] = True
            edge = gone.astype(np.int32)
            edge[WINDOW:] -= gone[:-WINDOW]
            covered = np.cumsum(edge)[: len(own.data)] > 0
            held = ~covered
            total = np.concatenate([[0], np.cumsum(covered)])
            begins = covered.copy()
            begins[1:] &= held[:-1]
            starts = own.ends - own.sizes
            inner = starts[(starts < len(covered)) & (own.sizes > 0)]
            begins[inner] = covered[inner]
            spans = np.concatenate([[0], np.cumsum(begins)])
            kept = [own.data[a:b][held[a:b]].tobytes() for a, b in zip(starts, own.ends, strict=True)]
            arrays = [pa.array(own.ids), pa.array(own.sizes), pa.array(total[own.ends] - total[starts]), pa.array((spans[own.ends] - spans[starts]).astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(kept, pa.binary())] if texts else [])], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])

    return run


def dedup_substrings(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with texts the kept bytes."""
    packed = settle(packs(docs), "suffix-packs")
    total = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    # A bucket is held by a task at a time, so their number follows the text; so does that of the tasks.
    width = max(2, shuffle_width(docs.sparkSession), -(-total // TASK))
    buckets = max(4 * width, -(-total // BUCKET))
    sent = packed.mapInArrow(_send_anchors(buckets), "bucket long, pack long, hashes binary")
    met = _by_bucket(sent, width).mapInArrow(_meet_anchors, "pack long, bucket long, bits binary")
    flags = met.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("flags"))
    flags = settle(flags, "suffix-flags")
    runs = settle(packed.join(flags, "pack", "left").mapInArrow(_send_runs(buckets), "bucket long, pack long, runs binary, blob binary"), "suffix-runs")
    release(flags)
    told = settle(_by_bucket(runs.where("bucket >= 0"), width).mapInArrow(_meet_runs(), "pack long, bucket long, bits binary"), "suffix-bits")
    parts = runs.select("pack", "bucket", "runs", F.when(F.col("bucket") < 0, F.col("blob")).alias("own")).join(told, ["pack", "bucket"], "left")
    parts = parts.groupBy("pack").agg(F.collect_list(F.struct("bucket", "runs", "own", "bits")).alias("parts"))
    out = packed.join(parts, "pack", "left").mapInArrow(_cut(texts), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), *out.columns[1:])


def _by_bucket(rows: DataFrame, width: int) -> DataFrame:
    """rows in as many tasks, buckets being numbered through: every task has as many."""
    return rows.repartitionById(width, F.pmod(F.col("bucket"), F.lit(width)).cast("int")).sortWithinPartitions("bucket", "pack")
