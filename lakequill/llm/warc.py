"""WARC archives: writing, and reading by boundary-chain verification.

Writing goes through Spark's text sink: a record is its header, an empty line and the block, and the line separator is
the blank line that ends a record, so the committer protocol covers lost executors. Reading splits archives at every
place that looks like a record boundary. Each candidate names its successor (its own offset, header and Content-Length
lead there). Inside a split, chains are followed in the task; across splits, pointer jumping over the few offsets at
which chains leave a split marks what the file start reaches. Only these are records: a boundary inside a payload is
not reached and stays payload.

Gzip archives (.gz, a member per record or one member) are read the same way, over the unpacked bytes.

Defined cases: a null payload is empty; a record that cannot be read ends the chain of its file: neither it nor what follows
is returned. Such is a record whose header has no end, no Content-Length or one that is not a whole number, and one cut
short, whose length (however large) reaches beyond the end of its file; the blank line after the last record may miss. An empty
table writes no record and reads as an empty result; ids may repeat, and then the record ids do too; extra columns are
not written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakequill.llm.common import fresh_path, settle

# Fixed values of the format.
CRLF = "\r\n"
END = "\r\n\r\n"
VERSION = "WARC/1.1"
SPLIT = END + "WARC/1."
#: Payloads below this many bytes are never revisited.
LEAST_REVISIT = 100


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{CRLF}{name}: "), value)


def record_text(key: Column, uri: Column, date: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A whole record without the blank line that ends it; refers_to null makes a response."""
    urn = lambda k: F.concat(F.lit("<urn:page:"), k.cast("string"), F.lit(">"))
    revisit = refers_to.isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    clean = F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\r\n]", "")
    return F.concat(
        F.lit(VERSION),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", urn(F.coalesce(key.cast("string"), F.lit("")))),
        _line("WARC-Target-URI", clean),
        _line("WARC-Date", date),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", urn(refers_to)))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )


def write_warc(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", gzip: bool = False) -> None:
    """One record per row. Of equal payloads of at least LEAST_REVISIT bytes, that with the smallest key is a response."""
    own = pages.select(F.col(key).alias("k"), F.col(uri).cast("string").alias("u"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))
    own = own.withColumn("d", F.sha2(F.col("p").cast("binary"), 256))
    firsts = own.where(F.octet_length("p") >= LEAST_REVISIT).groupBy("d").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "first")
    firsts = settle(firsts, "warc-firsts")  # its real size decides whether payloads have to move
    linked = own.join(firsts, "d", "left").withColumn("r", F.when(~F.col("k").eqNullSafe(F.col("first")), F.col("first")))
    text = record_text(F.col("k"), F.col("u"), F.lit(date), F.col("p"), F.col("d"), F.col("r"))
    linked.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip" if gzip else "none").text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between boundary candidates: file, blk (start of the split), mid (order), value, size in bytes."""
    raw = spark.read.option("lineSep", SPLIT).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("mid"), F.col("value"), F.octet_length("value").cast("long").alias("size"),
    )


def _header(value: Column) -> Column:
    """The header of a segment. One that has no empty line ends where the next candidate's begins."""
    return F.substring_index(value, END, 1)


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.rtrim(found))


def _length(header: Column) -> Column:
    """Content-Length, null where it is not a whole number; one beyond 18 digits is beyond any file."""
    told = _field(header, "Content-Length")
    return F.when(told.rlike("^[0-9]+$"), F.when(F.length(told) <= 18, told.try_cast("long")).otherwise(F.lit(10**18)))


_LINKS = "file string, blk long, mid long, off long, succ long, leaves long"


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split, where its chain leaves the split (-1: it breaks inside)."""
    pdf = pdf.sort_values("off")
    off, succ = pdf["off"].to_numpy(), pdf["succ"].to_numpy()
    leaves = np.where(succ < 0, -1, succ)
    last = off[-1]
    at = np.searchsorted(off, succ)
    for i in range(len(off) - 1, -1, -1):
        s = succ[i]
        if 0 <= s <= last:
            j = at[i]
            leaves[i] = leaves[j] if off[j] == s else -1
    return pdf.assign(leaves=leaves)[["file", "blk", "mid", "off", "succ", "leaves"]]


def _mark(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates that the split's entries reach."""
    pdf = pdf.sort_values("off")
    off, succ, seen = pdf["off"].to_numpy(), pdf["succ"].to_numpy(), pdf["entry"].to_numpy(dtype=bool).copy()
    at = np.minimum(np.searchsorted(off, succ), len(off) - 1)
    for i in range(len(off)):
        if seen[i] and succ[i] >= 0 and off[at[i]] == succ[i]:
            seen[at[i]] = True
    return pdf.assign(real=seen)[["file", "blk", "mid", "off", "succ", "real"]]


def candidates(segments: DataFrame) -> DataFrame:
    """file, blk, mid (its rank in the split), off, succ of each segment; off is where its version line begins, succ is -1 if it
    cannot be read or ends beyond its file.

    The first segment of a file holds its own version line; the others begin after the separator.
    """
    sep = len(SPLIT)
    header = _header(F.col("value"))
    slim = segments.select("file", "blk", "mid", "size", F.octet_length(header).cast("long").alias("head"), _length(header).alias("length"))
    slim = settle(slim, "warc-segments")
    blocks = slim.groupBy("file", "blk").agg(F.sum(F.col("size") + sep).alias("total"), F.min("mid").alias("lowest"))
    ends = F.sum("total").over(Window.partitionBy("file")) - sep
    starts = blocks.select("file", "blk", "lowest", ends.alias("end"), F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum(F.col("size") + sep).over(Window.partitionBy("file", "blk").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = slim.withColumn("inside", inside).join(starts, ["file", "blk"]).withColumn("at", F.col("base") + F.col("inside"))
    # `at` is where the segment's text begins; its version line begins 7 bytes earlier, but for the file's first.
    off = F.when(F.col("at") == 0, F.lit(0)).otherwise(F.col("at") - 7).cast("long")
    stop = F.col("at") + F.col("head") + 4 + F.col("length")
    succ = F.when(stop <= F.col("end"), stop + 4)
    return placed.select("file", "blk", (F.col("mid") - F.col("lowest")).alias("mid"), off.alias("off"), F.coalesce(succ, F.lit(-1)).cast("long").alias("succ"))


def reachable(found: DataFrame, rounds: int = 64) -> DataFrame:
    """The candidates that the file start reaches: file, blk, mid, off, succ."""
    found = settle(found.groupBy("file", "blk").applyInPandas(_follow, _LINKS), "warc-links")
    reached = found.where("off = 0").select("file", "off")
    if not found.groupBy("file").agg(F.min("blk").alias("lo"), F.max("blk").alias("hi")).where("lo < hi").isEmpty():
        reached = _jumped(found, rounds)
    marked = found.join(reached.withColumn("entry", F.lit(True)), ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    real = marked.select("file", "blk", "mid", "off", "succ", "entry").groupBy("file", "blk").applyInPandas(_mark, "file string, blk long, mid long, off long, succ long, real boolean")
    return settle(real, "warc-real")


def _jumped(found: DataFrame, rounds: int) -> DataFrame:
    """file, off of the entries of splits that the file starts reach, by pointer jumping."""
    exits = found.select("file", F.col("leaves").alias("off")).where("off >= 0").distinct()
    entries = found.join(exits, ["file", "off"], "left_semi").union(found.where("off = 0").select("file", "off", "blk", "mid", "succ", "leaves")).select("file", "off", F.col("leaves").alias("to")).distinct()
    jumps = settle(entries, "warc-entries")
    reached = settle(jumps.where("off = 0").select("file", "off"), "warc-reached")
    count = reached.count()
    for _ in range(rounds):
        grown = settle(reached.union(reached.join(jumps, ["file", "off"]).join(jumps.select("file", F.col("off").alias("to"), F.lit(True).alias("there")), ["file", "to"]).select("file", F.col("to").alias("off"))).distinct(), "warc-reached")
        now = grown.count()
        if now == count:
            break
        reached, count = grown, now
        far = jumps.select("file", F.col("off").alias("to"), F.col("to").alias("next"))
        jumps = settle(jumps.join(far, ["file", "to"], "left").select("file", "off", F.coalesce("next", "to").alias("to")), "warc-jumps")
    return reached


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, header, record_type, record_id, uri, refers_to, digest, block_length, payload (string).

    The payload is the block, less the HTTP header where the record holds an HTTP message. Records that a separator
    look-alike cuts into several segments are put together again; all others never leave their task.
    """
    real = reachable(candidates(_segments(spark, path)))
    # The record of a segment is the last reachable one at or before it that reaches beyond it.
    own = F.when(F.col("real"), F.struct("off", "succ"))
    inside = Window.partitionBy("file", "blk").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    carried = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    lasts = real.groupBy("file", "blk").agg(F.max(own).alias("last")).select("file", "blk", F.max("last").over(carried).alias("before"))
    owned = real.join(lasts, ["file", "blk"]).withColumn("r", F.coalesce(F.max(own).over(inside), F.col("before")))
    owned = owned.withColumn("rec", F.when(F.col("r.succ") > F.col("off"), F.col("r.off")))
    pieces = owned.groupBy("file", "rec").agg(F.count(F.lit(1)).alias("n")).where("rec is not null and n > 1")
    # All segments but these are whole records, so payloads move only where a look-alike has cut one.
    odd = owned.join(pieces, ["file", "rec"], "left").where("rec is null or n > 1").select("file", "blk", "mid", "off", "rec")
    odd = settle(odd, "warc-odd")
    segs = _segments(spark, path)
    if not odd.isEmpty():
        # Ids count through a task; a second scan may deal splits otherwise, so they are taken relative to their split.
        lowest = settle(segs.groupBy("file", "blk").agg(F.min("mid").alias("lowest")), "warc-lowest")
        segs = segs.join(lowest, ["file", "blk"]).withColumn("mid", F.col("mid") - F.col("lowest"))
    single = segs.join(odd, ["file", "blk", "mid"], "left_anti").select("file", "value")
    cut = segs.join(odd.where("rec is not null"), ["file", "blk", "mid"]).groupBy("file", "rec").agg(F.sort_array(F.collect_list(F.struct("off", "value"))).alias("parts"))
    joined = cut.select("file", F.expr("array_join(transform(parts, x -> x.value), sep)".replace("sep", "'" + SPLIT.replace("\r", "\\r").replace("\n", "\\n") + "'")).alias("value"))
    records = single.union(joined)
    header = _header(F.col("value"))
    length = _length(header)
    start = F.octet_length(header) + 5
    block = F.substring(F.col("value").cast("binary"), start, F.least(length, F.lit((1 << 31) - 1)).cast("int")).cast("string")
    is_http = F.coalesce(_field(header, "Content-Type"), F.lit("")).startswith("application/http")
    out = records.select("file", header.alias("header"), block.alias("block"), length.alias("block_length"), is_http.alias("http"))
    body = F.when(F.col("http"), F.expr(f"substring(block, instr(block, '{END}') + 4)".replace(END, "\\r\\n\\r\\n"))).otherwise(F.col("block"))
    return out.select(
        "file", "header", _field(F.col("header"), "WARC-Type").alias("record_type"), _field(F.col("header"), "WARC-Record-ID").alias("record_id"),
        _field(F.col("header"), "WARC-Target-URI").alias("uri"), _field(F.col("header"), "WARC-Refers-To").alias("refers_to"),
        _field(F.col("header"), "WARC-Payload-Digest").alias("digest"), "block_length",
        F.when(F.col("http"), F.regexp_extract("block", r"(?i)^[^\r\n]*(?:\r\n[^\r\n]+)*?\r\nContent-Length:[ \t]*([0-9]+)", 1).try_cast("long")).alias("http_length"), body.alias("payload"),
    )


def page_records(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as an archive, read it back: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    verified tells whether the digest of the payload that was read equals the header's (null for a revisit, whose
    payload is the referred record's; its length is that of the HTTP header it repeats).
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_warc(pages, path)
    records = read_warc(spark, path)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    response = F.col("record_type") == "response"
    own = F.sha2(F.col("payload").cast("binary"), 256)
    told = F.regexp_extract("digest", "sha256:([0-9a-f]{64})", 1)
    return records.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, own).otherwise(told).alias("payload_digest"),
        "record_type", F.when(~response, number(F.coalesce("refers_to", F.lit("")))).alias("refers_to"),
        F.when(response, own == told).alias("verified"),
    )
