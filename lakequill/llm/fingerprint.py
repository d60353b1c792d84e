"""Document fingerprints: canonical exact digests.

A text is normalised (NFKC), case-folded, and its white space runs become single spaces without ends; the digest is the
128-bit xxhash of the UTF-8 bytes. Inside buckets of equal digests the canonical bytes are compared with those of the
bucket's first document; texts that differ get a numbered digest of their own, so equal fingerprints mean equal
canonical texts, always. The likeness of two exact digests is 1 or 0.

Documents are dealt to ranges of descending ids; an id that fills ranges of its own is dealt further by its texts' hashes.

Defined cases: a null text is the empty text; a null id stands after all others; equal ids are ordered by the hash of their
texts, then by text; a single document is its own next one; an empty table gives an empty result; lone surrogates cannot
occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakequill.llm.common import settle, shuffle_width, small_batches


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


#: Bits of the map of shared digests: fixed, so what is broadcast never grows.
BITS = 1 << 26


def _spots(digests: list[str]) -> np.ndarray:
    return np.array([int(d[:12], 16) for d in digests], dtype=np.int64) % BITS


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"d": [digest(canonical(t)) for t in frame["text"]]})


def shared_bitmap(docs: DataFrame, text: str = "text") -> np.ndarray:
    """A bitmap of fixed size (BITS) that holds every digest of two documents or more, and some others by chance."""
    found = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(_digests, "d string")
    spot = F.conv(F.substring("d", 1, 12), 16, 10).cast("long") % BITS
    words = (
        found.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(spot.alias("spot")).groupBy(F.expr("spot div 63").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 63 as int))")).alias("bits"))
    )
    map_ = np.zeros(BITS // 63 + 1, dtype=np.int64)
    for batch in words.toPandas().itertuples(index=False):
        map_[batch.word] = batch.bits
    return map_


def _chain(shared: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows come sorted by part and descending id; the guest ends its part: it is the document that begins the next."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, pack, last = shared.value, zstandard.ZstdCompressor(level=1).compress, None

        def row(own: tuple, following: str, next_canon: str) -> tuple:
            _, doc, text, canon = own
            changed, mark = edited(text, following), digest(canon)
            other = canonical(changed)
            spot = int(_spots([mark])[0])
            blob = pack(canon.encode()) if bits[spot // 63] >> (spot % 63) & 1 else None
            return doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, digest(other), float(other == canon), float(next_canon == canon), blob

        for frame in frames:
            out = []
            for part, doc, guest, text in zip(frame["part"], frame["doc_id"].astype(object), frame["guest"], frame["text"], strict=True):
                canon = canonical(text)
                if last is not None and last[0] == part:
                    out.append(row(last, text, canon))
                last = None if guest else (part, None if pd.isna(doc) else int(doc), text, canon)
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pd.DataFrame({n: pd.Series(c, dtype="Int64" if n == "doc_id" else None) for n, c in zip(_COLUMNS, cols, strict=True)})

    return run


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "blob"]
_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, blob binary"
#: Where a null id stands: after all others. Values that a text's hash may take in the order of equal ids.
_LAST, _SPAN = -(1 << 63), 1 << 30


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int | None = None) -> DataFrame:
    """part, ord, mark, doc_id, guest, text: ranges of descending ids, each with the first document of the range that follows.

    Texts move once. Only the range bounds, as many as ranges, are known to the driver. An id that is several bounds at once
    has as many ranges, by the hash of the text.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("ord", F.coalesce("doc_id", F.lit(_LAST))).withColumn("mark", F.pmod(F.xxhash64("text"), F.lit(_SPAN)))
    width = width or max(2, shuffle_width(docs.sparkSession))
    cuts = sorted(rows.agg(F.percentile_approx("ord", [k / width for k in range(1, width)], 100 * width)).first()[0] or [], reverse=True)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.expr("cast(array() as array<long>)")
    own = F.size(F.filter(bounds, lambda c: c == F.col("ord")))
    part = F.size(F.filter(bounds, lambda c: c > F.col("ord"))) + F.floor(F.col("mark") * own / F.lit(_SPAN)).cast("int")
    placed = rows.withColumn("part", part)
    place = F.struct((-1 - F.col("ord")).alias("below"), "mark")
    heads = sorted((r.part, tuple(r.head)) for r in placed.groupBy("part").agg(F.min(place).alias("head")).collect())
    empty = placed.select("part", "ord", "mark", "doc_id", F.lit(False).alias("guest"), "text")
    if not heads:
        return empty
    before = docs.sparkSession.createDataFrame([(-1 - below, mark, heads[k - 1][0]) for k, (_, (below, mark)) in enumerate(heads)], "ord long, mark long, to int")
    once = placed.join(F.broadcast(before), ["ord", "mark"]).groupBy("to", "ord", "mark", "doc_id").agg(F.min("text").alias("text"))
    return empty.union(once.select(F.col("to").alias("part"), "ord", "mark", "doc_id", F.lit(True).alias("guest"), "text"))


def verified(rows: DataFrame) -> DataFrame:
    """rows without blob; digests whose buckets hold different canonical bytes are numbered in the order of their first id.

    blob holds the packed canonical bytes of every document whose digest may be shared: equal bytes, equal blobs.
    Grouping by digest and blob compares the bytes, after a partial aggregate that reduces copies where they lie.
    """
    kinds = rows.where("blob is not null").groupBy("fingerprint", "blob").agg(F.min("doc_id").alias("first"))
    clash = kinds.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    if clash.isEmpty():
        return rows.drop("blob")
    order = Window.partitionBy("fingerprint").orderBy(F.col("first").asc_nulls_last(), "blob")
    numbered = kinds.join(clash, "fingerprint", "left_semi").withColumn("number", F.row_number().over(order) - 1).select("fingerprint", "blob", "number")
    named = F.when(F.coalesce("number", F.lit(0)) > 0, F.concat("fingerprint", F.lit("-"), F.col("number"))).otherwise(F.col("fingerprint"))
    out = rows.join(numbered, ["fingerprint", "blob"], "left")
    same = F.col("near_edited") == 1.0
    return out.withColumn("edited_fingerprint", F.when(same, named).otherwise(F.col("edited_fingerprint"))).withColumn("fingerprint", named).select(*[c for c in _COLUMNS if c != "blob"])


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(shared_bitmap(docs, text))
    near = neighbours(docs, key, text)
    width = max(2, shuffle_width(spark))
    dealt = near.repartitionById(width, F.pmod(F.col("part"), F.lit(width))).sortWithinPartitions(F.col("part"), F.col("guest"), F.col("ord").desc(), F.col("mark"), F.col("text"))
    return verified(settle(small_batches(dealt.select("part", "doc_id", "guest", "text")).mapInPandas(_chain(shared), _ROW), "fp-rows"))
