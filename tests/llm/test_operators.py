import collections
import datetime
import hashlib
import math
import re
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lakequill.llm import bytesx, common, fingerprint, flat_graph, mixing, ngram_join, pii, quality, sharding, suffix_dedup, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, rep string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two three", None), (3, "one two three", None), (None, "w " * 30, "b"), (5, "long " * 30_000, "b"), (6, "one two three", "a"), (7, " \n\t", "c")]
    return docs_of(spark, rows)


# WARC
def test_warc_round_trip_with_lookalikes(spark):
    html = ["x" * 150, "x" * 150, "", "abc", None, "abc", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello", "a\r\n\r\nWARC/1.", "\r\n\r\nWARC/1.", "\r\n" * 5 + "WARC/1.1\r\n\r\n", "WARC/1.1\r\n", "é\r\n\r\n"]
    html += ["y" * (i * 37 % 5000) + "\r\n\r\nWARC/1.1\r\nContent-Length: 12\r\n\r\n" for i in range(60)]
    pages = spark.createDataFrame([(i, f"http://x/{i} WARC/1.1", h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, file int").repartition(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = warc.page_records(pages).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(html)
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h, i)
    for r in got:
        raw = (html[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        again = len(raw) >= 100 and first[html[r.page_id]] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[html[r.page_id]]) if again else ("response", None))


def test_warc_gzip_broken_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "p" * 200), (2, None, "q")], "page_id long, url string, html string")
    path = common.fresh_path(spark, "gz")
    warc.write_warc(pages, path, gzip=True)
    assert sorted(r.payload for r in warc.read_warc(spark, path).collect()) == ["p" * 200, "q"]
    assert warc.page_records(pages.limit(0)).count() == 0
    path = common.fresh_path(spark, "broken")
    good = "WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nhi"
    spark.createDataFrame([(good + "\r\n\r\n" + "WARC/1.1\r\nContent-Length: x\r\n\r\nzz" + "\r\n\r\n" + good,)], "v string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    assert [r.payload for r in warc.read_warc(spark, path).collect()] == ["hi"]


def test_warc_lengths_that_lie(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {}\r\n\r\n"
    good, want = head.format(2) + "hi\r\n\r\n", set()
    for name, last, payloads in (
        ("oversized", head.format(99999999999) + "zz\r\n\r\n", ["hi"]), ("enormous", head.format("9" * 40) + "zz\r\n\r\n", ["hi"]), ("negative", head.format(-3) + "zz\r\n\r\n", ["hi"]),
        ("short", head.format(50) + "zz\r\n\r\n", ["hi"]), ("by_one", head.format(7) + "zz\r\n\r\n", ["hi"]), ("no_header_end", "WARC/1.1\r\nContent-Length: 4", ["hi"]), ("no_length", "WARC/1.1\r\nX: 1\r\n\r\nzz\r\n\r\n" + good, ["hi"]),
        ("no_last_line", head.format(2) + "zz", ["hi", "zz"]), ("empty_block", head.format(0) + "\r\n\r\n", ["", "hi"]), ("inside", head.format(1) + "zz\r\n\r\n" + good, ["hi", "z"]), ("not_warc", "", ["hi"]),
    ):
        (tmp_path / f"{name}.warc").write_bytes((good + last).encode())
        want |= {(name, p) for p in payloads}
    (tmp_path / "other.warc").write_bytes(b"no archive at all\r\n\r\nWARC/1.1\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")
    got = [(r.file.rsplit("/", 1)[1].removesuffix(".warc"), r.payload) for r in warc.read_warc(spark, f"file://{tmp_path}").collect()]
    assert len(got) == len(want) and set(got) == want


# Mixing
def test_mixing(spark, odd):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 5 else None) for i in range(3000)] + [(9000 + i, "w w", "s9") for i in range(3)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert {r.doc_id: (r.size, r.copies) for r in got} == {r.doc_id: (r.size, r.copies) for r in mixing.mix(docs_of(spark, rows[::-1])).collect()}
    total = sum(r.size for r in got)
    sources = {r.source: (r.source_size, r.target) for r in got}
    assert math.isclose(sum(t for _, t in sources.values()), total)
    names = sorted((s for s in sources if s), key=str.encode) + [None]
    share = [sources[s][1] / [5, 2, 1][k % 3] for k, s in enumerate(names) if sources[s][1] < 3 * sources[s][0]]
    assert max(share) - min(share) < 1e-6 and all(t <= 3 * s for s, t in sources.values())
    for s, (_, target) in sources.items():
        assert abs(sum(r.taken for r in got if r.source == s) - target) <= 4  # half of the longest document
    assert all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mix(odd).count() == odd.count()
    assert {r.size for r in mixing.mix(odd).where("doc_id in (1, 2, 7)").collect()} == {0}
    assert mixing.mixed_documents(odd).columns == odd.columns
    taken = collections.Counter(r.doc_id for r in mixing.mixed_documents(docs_of(spark, rows)).select("doc_id").collect())
    assert taken == {r.doc_id: r.copies for r in got if r.copies}


def test_mixing_thresholds_against_a_plain_walk(spark, monkeypatch):
    # Few long documents: draws of their own would miss the targets by far.
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(np.exp(rng.uniform(0, 7))), f"s{i % 7}") for i in range(210)] + [(None, "w " * 9, "s1"), (None, "w " * 8, "s1"), (7, "w " * 40, "s0")]
    for digits in ((3, 5), (1, 2)):
        monkeypatch.setattr(mixing, "DIGITS", digits)
        got = mixing.mix(docs_of(spark, rows)).collect()
        for source in {r.source for r in got}:
            mine = [r for r in got if r.source == source]
            draws = collections.defaultdict(int)
            for r in mine:
                draws[hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13]] += r.size
            wanted, before, extra = mine[0].target - math.floor(mine[0].rate) * mine[0].source_size, 0, set()
            for d in sorted(draws):
                if mine[0].rate > math.floor(mine[0].rate) and before + draws[d] / 2 <= wanted:
                    extra.add(d)
                before += draws[d]
            for r in mine:
                d = hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13]
                assert r.copies == math.floor(r.rate) + (d in extra)
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(draws.values()) / 2 + 1e-6


# Sharding
def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, odd):
    ids = [*range(2000), -1, -5, 2**62, 2**63 - 1]
    got = sharding.shard_documents(docs_of(spark, [(i, "é", "s") for i in ids])).collect()
    for r in got:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id % 2**64, 40), jump(r.doc_id % 2**64, 41)) and r.grown_shard in (r.shard, 40) and r.size == 18
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = sharding.with_slots(spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("shard")), "shard", ("id",), "id", 20).collect()
    assert sorted((r.shard, r.slot) for r in many) == sorted((s, k) for s in range(3) for k in range(334 if s == 0 else 333))
    assert sharding.shard_documents(odd).count() == odd.count() and sharding.shard_documents(odd.limit(0)).count() == 0


# Quality
def test_quality_held_out(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), size=rng.integers(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(words, size=rng.integers(20, 90)))
        if i % 4 == 0:
            text = [w.upper() + "!!" for w in text] if i % 8 else [text[0]] * len(text)
        rows.append((i, " ".join(text), f"s{i % 4}"))
        labels.append((i, int(i % 4 != 0)))
    docs = docs_of(spark, [*rows, (1000, None, None), (1001, "", "s1"), (0, rows[0][1], "s0")])
    told = spark.createDataFrame(labels[:200], "doc_id long, quality int").withColumn("toxic", F.lit(0))
    model = quality.fit(docs, told)
    got = {r.doc_id: r.keep for r in quality.score(docs, model).collect()}
    assert np.mean([got[i] == bool(y) for i, y in labels[200:]]) > 0.97
    assert got[1000] is False and got[1001] is False
    kept = quality.kept_documents(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    assert quality.fit(docs, told.where("quality = 1")) is None and quality.score(docs, None).where("keep").count() == 401
    assert quality.fit(docs, told.limit(0)) is None and quality.score(docs.limit(0), model).count() == 0


def test_quality_sample_is_bounded_by_repeated_rows(spark):
    rows = [(1, "good text here", "s")] * 150 + [(1, "another text", "s")] + [(i, f"text {i} of its own", "s") for i in range(2, 40)] + [(None, "no id", "s")] * 9
    told = spark.createDataFrame([(1, 1, 0)] * 150 + [(2, 0, 0), (3, 1, 0), (4, 0, 0), (4, 1, 0), (5, 7, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    text, meta, y = quality._fit_rows(docs_of(spark, rows), told, 10, 7)
    assert len(text) == len(meta) == len(y) == 13 and sorted(y[~np.isnan(y)]) == [0, 1, 1]
    again = quality._fit_rows(docs_of(spark, rows[::-1]), told, 10, 7)
    assert (again[0] == text).all() and (again[1] == meta).all()


def plain_co_training(text, meta, y, more_text, more_meta, rounds, share=0.05, sure=0.9):
    """The same rounds with lists and loops; views are lists of rows."""
    fold = [i % 3 == 0 for i in range(len(y))]
    views, pools, extra = [text, meta], [more_text, more_meta], [[], []]
    taken = [set(), set()]

    def weights(v):
        rows = [(views[v][i], y[i], 1.0) for i in range(len(y)) if not fold[i]] + [(pools[v][i], label, 0.3) for i, label in extra[v]]
        return quality.fit_logistic(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def sure_of(w, row):
        return 1 / (1 + math.exp(-max(-40, min(40, float(np.dot(row, w[:-1]) + w[-1])))))

    models = [weights(0), weights(1)]
    for _ in range(rounds):
        for v in (0, 1):
            chances = [sure_of(models[v], row) for row in pools[v]]
            most = max(1, int(share * len(chances)))
            for label in (1.0, 0.0):
                own = [c if label else 1 - c for c in chances]
                first = sorted(range(len(own)), key=lambda i: -own[i])[: 4 * most]
                first = [i for i in first if own[i] >= sure and i not in taken[1 - v]][:most]
                taken[1 - v] |= set(first)
                extra[1 - v] += [(i, label) for i in first]
        models = [weights(0), weights(1)]
    return models, extra


def test_co_training_against_plain_loops_and_without_exchange():
    # Each view tells the classes apart by two features; the few labels hold only one of them, the other comes by exchange.
    rng = np.random.default_rng(23)

    def draw(n, seen):
        y = rng.integers(0, 2, n)
        noise = lambda: rng.normal(size=(n, 4)) * 0.3
        text, meta = noise(), noise()
        kind = np.zeros(n, int) if seen else rng.integers(0, 2, n)
        text[np.arange(n), kind] += 4 * y - 2
        meta[:, 0] += 4 * y - 2
        return text, meta, y.astype(float)

    text, meta, y = draw(30, True)
    more_text, more_meta, _ = draw(400, False)
    test_text, test_meta, want = draw(600, False)
    model = quality.co_train(text, meta, y, more_text, more_meta, rounds=4)
    models, extra = plain_co_training(text, meta, y, more_text, more_meta, 4)
    assert np.allclose(model.text, models[0], atol=1e-6) and np.allclose(model.meta, models[1], atol=1e-6) and all(extra)
    alone = quality.co_train(text, meta, y, more_text, more_meta, rounds=0)
    hit = lambda m: np.mean((quality.margin(test_text, m.text) > 0) == want)
    assert hit(model) > hit(alone) + 0.05


# N-gram join
def grams(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_join(rows):
    sets = {i: grams(t) for i, t in rows}
    links = {i: {j for j, b in sets.items() if j != i and a and 9 * len(a & b) >= 4 * (len(a) + len(b))} for i, a in sets.items()}
    comp = {}
    for i in sorted(sets):
        todo = [] if i in comp else [i]
        while todo:
            u = todo.pop()
            if u not in comp:
                comp[u] = i
                todo += links[u]
    return {i: (comp[i], len(links[i]), min([i, *(j for j in links[i] if sets[j] == sets[i])])) for i in sets}


def test_ngram_join(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = list(rng.choice(words, size=rng.integers(4, 120)))
        for _ in range(rng.integers(1, 9)):
            text = list(base)
            for _ in range(rng.integers(0, 4)):
                text[rng.integers(0, len(text))] = str(rng.choice(words))
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "a"), (len(rows) + 3, "a "), (len(rows) + 4, "a b c d")]
    want = brute_join(rows)
    for block in (1024, 3):
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
        got = ngram_join.jaccard_join(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()
        assert {r.doc_id: (r.component_id, r.n_links, r.class_id) for r in got} == want
    assert ngram_join.bands_for(0.8, 0.9995) == (20, 5)


def test_ngram_join_deals_null_and_repeated_ids_once(spark, monkeypatch):
    # Every text comes twice; a third of the rows have no id, others share one. A class is dealt once to each of its buckets.
    real = ngram_join._verify

    def counted(*args):
        run = real(*args)

        def both(batches):
            held = list(batches)
            count.add(sum(len(b) for b in held))
            yield from run(iter(held))

        return both

    monkeypatch.setattr(ngram_join, "_verify", counted)
    for many in (40, 80):
        count = spark.sparkContext.accumulator(0)
        rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, " ".join([*(f"w{i}" for i in range(60)), f"x{k // 2}"]), "s") for k in range(many)]
        got = ngram_join.jaccard_join(docs_of(spark, rows)).collect()
        assert many / 2 <= count.value <= 20 * many / 2
        assert len(got) == many and {r.n_links for r in got} == {many - 1} and {r.component_id for r in got} == {2}
        kept = ngram_join.one_of_each(docs_of(spark, rows)).collect()
        assert [r.doc_id for r in kept] == [2]


def test_one_of_each_keeps_different_texts_of_one_id(spark):
    rows = [(7, "one text of some words", "s"), (7, "and quite another text of words", "s"), (None, "no id a b c", "s"), (None, "no id a b c", "t"), (None, "else d e f g", "s"), (9, "one text of some words", "s")]
    got = sorted((r.doc_id or 0, r.text) for r in ngram_join.one_of_each(docs_of(spark, rows)).collect())
    assert got == [(0, "else d e f g"), (0, "no id a b c"), (7, "and quite another text of words"), (7, "one text of some words")]
    twice = [ngram_join.one_of_each(docs_of(spark, r)).orderBy("text", "doc_id").collect() for r in (rows, rows[::-1])]
    assert twice[0] == twice[1]
    names = docs_of(spark, rows).withColumnsRenamed({"part": "_word", "rep": "_bits", "lang": "_id"})
    assert ngram_join.one_of_each(names).columns == names.columns


def test_one_of_each(spark, odd):
    docs = docs_of(spark, [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (4, "a b c d e  f", "s"), (None, "z", "s"), (2, None, "s"), (3, "", "s")])
    assert sorted((r.doc_id or 0, r.text or "") for r in ngram_join.one_of_each(docs).collect()) == [(0, "z"), (1, "a b c d e f"), (2, ""), (3, "")]
    assert ngram_join.one_of_each(odd).columns == odd.columns
    assert ngram_join.jaccard_join(odd).count() == odd.count() and ngram_join.one_of_each(odd.limit(0)).count() == 0


# PII
def test_feistel_and_values():
    f = pii.Feistel(b"k")
    for size in (2, 10, 777, 1000):
        image = [f.permute(i, size, "t") for i in range(size)]
        assert sorted(image) == list(range(size)) and [f.permute(v, size, "t", back=True) for v in image] == list(range(size))
    names = pii.Pseudonyms(b"k")
    text = 'card 4785380592391139, not 2123465659789240; 70.23.22.57 +1 (743) 555-3824 a.b7@mail7.example.com token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 2024-02-29 123-45-6789 GB82 WEST 1234 5698 7654 32 999.1.1.1'
    out = names.text(text)
    assert len(out) == len(text) and "2123465659789240" in out and "999.1.1.1" in out and "@mail7.example.com" in out
    for value in ("4785380592391139", "70.23.22.57", "555-3824", "04dbebab91", "2024-02-29", "123-45-6789", "5698 7654", "a.b7@"):
        assert value not in out
    assert pii.luhn(re.search(r"card (\d+)", out)[1]) and pii.Pseudonyms(b"k").text(text) == out and pii.Pseudonyms(b"other").text(text) != out


def test_cards_beside_other_numbers():
    names, card = pii.Pseudonyms(b"k"), "4785380592391139"
    new, grouped = names.text(card), "4785 3805 9239 1139"
    ip, date = names.text("97.51.17.173"), names.text("12/25/2024")
    assert new != card and ip != "97.51.17.173"
    for text in ("{} 12 items", "{} 123", "{} 1", "12 {}", "7 {} 12", "{0} {0}", "1 2 3 {} 4 5 6", "{} 97", "1234 {} 1234"):
        assert names.text(text.format(card)) == text.format(new)
    assert names.text(f"pay {card} 97.51.17.173 now") == f"pay {new} {ip} now" and names.text(f"{card} 12/25/2024") == f"{new} {date}"
    assert names.text(f"97.51.17.173 {card}") == f"{ip} {new}" and names.text("2123465659789240 97.51.17.173") == f"2123465659789240 {ip}"
    assert names.text(f"AB12 {grouped}") == "AB12 " + names.text(grouped) and names.text(f"{grouped} 123") == names.text(grouped) + " 123"
    # Numbers of which some other ending or beginning is valid by chance do not take a card or an address away.
    for n in range(1000):
        assert names.text(f"{card} {n}") == f"{new} {n}" and names.text(f"{n} {card}") == f"{n} {new}"
        assert names.text(f"{card[:-1]}0 {n % 256}.51.17.173").startswith(f"{card[:-1]}0 ")
    for text in (f"{card}-12", f"12-{card}", f"x{card}", f"{card}5", "0000000000000 12", "2123465659789240 12"):
        assert names.text(text) == text


def test_different_values_keep_different_pseudonyms():
    names = pii.Pseudonyms(b"k")
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(d) for d in range(3000)]
    whole = {datetime.date(1900, 1, 1) + datetime.timedelta(d) for d in range(73049)}
    forms = {
        "date": {d.strftime(f) for d in days for f in ("%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d")},
        "card": {b + pii.check_digit(b) for b in (f"4{n:014d}" for n in range(1, 2000))}, "ssn": {f"123-45-{n:04d}" for n in range(1, 2000)},
        "ip": {f"10.{n // 200}.7.{n % 200}" for n in range(2000)}, "phone": {f"555-{n:03d}-{n * 7 % 10000:04d}" for n in range(1000)} | {f"+44 20 {n:04d} 1234" for n in range(1000)},
        "mail": {f"user{n}@example.com" for n in range(1500)} | {f"ñandu.{n}@example.com" for n in range(500)}, "secret": {f"token = '{n:020x}'" for n in range(1500)},
    }
    for kind, values in forms.items():
        given = {v: names.text(f"at {v} !") for v in values}
        assert len(set(given.values())) == len(values), kind
        assert all(len(g) == len(v) + 5 for v, g in given.items()) and sum(g == f"at {v} !" for v, g in given.items()) <= 2, kind
    assert names.text("12/05/1992") != names.text("27/02/1990")
    late = [d for d in whole if d.day > 12]
    assert len({names.value("date", d.strftime("%d/%m/%Y")) for d in late}) == len(late)
    for text in ("٤٧٨٥٣٨٠٥٩٢٣٩١١٣٩ 7", "1.2.3.4.5", "call 12-345-6789", "x555-123-4567", "v 123.456.7890.1", "+2 1"):
        assert names.text(text) == text
    with pytest.raises(ValueError):
        pii.pseudonymise(None, "")


def test_pii_rows(spark, odd):
    pseudonymise = lambda df: pii.pseudonymise(df, "k")
    assert [r.text for r in pseudonymise(odd).collect()] == [r.text for r in odd.collect()] and pseudonymise(odd).schema == odd.schema
    got = pii.pseudonym_rows(docs_of(spark, [(1, "x 4785380592391139", "s"), (2, "4785380592391139 y", "s"), (3, None, "s")]), "k").orderBy("doc_id").collect()
    assert got[0].text[2:] == got[1].text[:16] != "4785380592391139" and got[2].text is None and [r.changed for r in got] == [True, True, False]


# Suffix dedup
def brute_cut(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - 99):
            gone[k : k + 100] |= raw[k : k + 100] in seen
            seen.add(raw[k : k + 100])
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_dedup(spark, monkeypatch):
    rng = np.random.default_rng(11)
    pieces = ["".join(rng.choice(list("abcdé "), size=n)) for n in (40, 99, 100, 101, 150, 400)]
    rows = [(i, "".join(rng.choice(pieces) + str(rng.integers(0, 3)) for _ in range(rng.integers(0, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 350), (103, "a" * 99), (104, "a" * 100), (105, "xy" * 90)]
    docs = docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(3)
    for pack in (1 << 21, 2000):
        monkeypatch.setattr(suffix_dedup, "PACK", pack)
        got = suffix_dedup.dedup_substrings(docs).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == brute_cut(rows)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 200)  # more buckets than anchors
    monkeypatch.setattr(suffix_dedup, "TASK", 3000)
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup_substrings(docs).collect()} == brute_cut(rows)
    assert suffix_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_suffixes_in_alphabetical_order():
    rng = np.random.default_rng(5)
    for pieces in ([b"ab", b"ba", b"a" * 60], [b"a" * 95, b"b", b"aaaaaaaaab"], [b"x" * 300], [bytes([k]) for k in range(256)], [b"abcdefgh" * 12 + b"1234", b"2"]):
        data = np.frombuffer(b"".join(rng.choice(np.array(pieces, dtype=object), size=60)) + b"\0" * 100, np.uint8)
        at = np.flatnonzero(np.arange(len(data) - suffix_dedup.WINDOW) % 3 > 0)
        order = suffix_dedup.alphabetical(data, bytesx.prefix_hash(data), at)
        text = data.tobytes()
        assert at[order].tolist() == sorted(at.tolist(), key=lambda k: (text[k : k + suffix_dedup.WINDOW], k))


def test_suffix_anchors_in_steps_and_collisions(monkeypatch):
    data = np.frombuffer(("abcdefgh" * 9 + "".join(chr(97 + i * i % 26) for i in range(3000))).encode(), np.uint8)
    valid = np.ones(len(data), bool)
    valid[-99:] = False
    prefix = bytesx.prefix_hash(data)
    whole = {int(w): int(a) for b, n, a in zip(*suffix_dedup.anchors(prefix, valid), strict=True) for w in range(b, b + n)}
    monkeypatch.setattr(suffix_dedup, "STEP", 500)
    parts = {int(w): int(a) for b, n, a in zip(*suffix_dedup.anchors(prefix, valid), strict=True) for w in range(b, b + n)}
    assert whole == parts and len(whole) == valid.sum()
    monkeypatch.setattr(suffix_dedup, "piece_hash", lambda p, a, b: bytesx.piece_hash(p, a, b) % np.uint64(7))
    at = np.flatnonzero(valid)
    seen, want = set(), []
    for k in at:
        w = data[k : k + 100].tobytes()
        want.append(w in seen)
        seen.add(w)
    assert suffix_dedup.repeated(data, prefix, at).tolist() == want
    for part in (1, 64):  # sorted a byte value or a few at a time
        monkeypatch.setattr(suffix_dedup, "PART", part)
        assert suffix_dedup.repeated(data, prefix, at).tolist() == want


def test_polynomial_hashes_over_table_ends():
    data = np.random.default_rng(5).integers(0, 256, 200_000).astype(np.uint8)
    want, base = [0], 1
    for byte in data.tolist():
        want.append((want[-1] + (byte + 1) * base) % (1 << 64))
        base = base * bytesx.BASE % (1 << 64)
    assert bytesx.prefix_hash(data).tolist() == want
    at = np.array([0, 1, 65535, 65536, 65537, 131072, 199_999])
    assert bytesx.power(bytesx.INVERSE, at).tolist() == [pow(bytesx.INVERSE, int(k), 1 << 64) for k in at]
    assert bytesx.prefix_hash(data[:0]).tolist() == [0] and len(bytesx.power(bytesx.BASE, at[:0])) == 0


# Embeddings
def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = []
    for _ in range(25):
        base = rng.normal(size=16)
        rows += [base + rng.normal(size=16) * 0.06 for _ in range(rng.integers(1, 12))]
    rows += [rows[0], rows[0]] + [rng.normal(size=16) for _ in range(200)]
    x = np.array(rows, dtype=np.float32).astype(float)
    size = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / (size[:, None] * size[None]) >= 0.95
    np.fill_diagonal(near, False)
    table = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    table += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, [], 0), (905, [1.0], 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, node int")
    for block in (4096, 60):
        monkeypatch.setattr(flat_graph, "BLOCK", block)
        got = {r.vec_id: r for r in flat_graph.near_vectors(df).collect()}
        assert len(got) == len(table) and all(got[k].n_links == 0 and got[k].kept for k in range(900, 906))
        links = sum(got[i].n_links for i in range(len(x)))
        assert links >= 0.97 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(len(x)))
        comp = common.components(spark.createDataFrame([(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)], "a long, b long"))
        want = {r.node: r.comp for r in comp.collect()}
        assert np.mean([got[i].component_id == want.get(i, i) for i in range(len(x))]) > 0.97
    assert flat_graph.near_vectors(df.limit(0)).count() == 0 and flat_graph.near_vectors(df.where("vec_id >= 900")).count() == 6


def test_embeddings_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [2.0]), (5, [3.0]), (6, [-1.0]), (7, [1.0, 0.0, 0.0]), (8, None), (None, [1.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in flat_graph.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (0, 6, True), 7: (1, None, False), 8: (0, 8, True), None: (1, None, True)}


def test_a_dense_task_keeps_no_table_of_its_pairs():
    n = 2048
    x = np.ones(32) + np.random.default_rng(1).normal(size=(n, 32)) * 0.02
    zero, whole = np.zeros(n, np.int64), np.arange(n, dtype=np.int64) * 3 + 1
    vec = pa.array([v.tobytes() for v in x], pa.binary())
    built = next(flat_graph._build(iter([pa.RecordBatch.from_arrays([pa.array(zero), pa.array(whole), vec], ["task", "node", "vec"])])))
    names = ["task", "i", "j", "side", "shard", "home", "shards", "node", "rep", "copies", "vec", "near"]
    task = pa.RecordBatch.from_arrays([*[pa.array(zero)] * 6, pa.array([[0]] * n, pa.list_(pa.int64())), pa.array(whole), pa.array(whole), pa.array(zero + 2), vec, built.column(1)], names)
    tracemalloc.start()
    out = next(flat_graph._search(0.95)(iter([task])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(out["links"].to_pylist()) == {2 * (n - 1)} and set(out["others"].to_pylist()) == {n - 1} and set(out["root"].to_pylist()) == {1}
    assert most < 300 << 20  # all pairs at full width would be 2 GB


def test_embeddings_in_finer_shards(spark, monkeypatch):
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(300, 16))
    x = np.concatenate([c + rng.normal(size=(5, 16)) * 0.06 for c in centres]).astype(np.float32).astype(float)
    size = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / (size[:, None] * size[None]) >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for name, value in {"PER_SHARD": 100, "MOST_SHARDS": 4, "SPLIT": 300, "SHARD_SAMPLE": 200, "BLOCK": 128}.items():
        monkeypatch.setattr(flat_graph, name, value)
    seen, real = [], flat_graph.finer
    monkeypatch.setattr(flat_graph, "finer", lambda d, o, w, levels: seen.append((levels, real(d, o, w, levels))) or seen[-1][1])
    got = {r.vec_id: r for r in flat_graph.near_vectors(df, overlap=3).collect()}
    links = sum(r.n_links for r in got.values())
    assert len(got) == len(x) and 0.9 * near.sum() <= links and all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    levels, dealt = seen[0]
    members = dealt.selectExpr("node", "explode(shards) AS shard")
    assert levels and len(seen) == 1 and members.groupBy("shard").count().count() > 4 and members.distinct().count() == members.count()
    # A dense group: every vector links with every other one, and none of the links is lost.
    dense = np.ones(16) + rng.normal(size=(900, 16)) * 0.02
    got = flat_graph.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(dense)], "vec_id long, embedding array<double>")).collect()
    assert {r.n_links for r in got} == {899} and {r.component_id for r in got} == {0} and seen[-1][0] == 0


@pytest.mark.parametrize("copies", [True, False])
def test_embeddings_audit_sees_lost_links_beside_large_groups(spark, monkeypatch, copies):
    # Exact copies, or one large group, with all their links found do not make up for the lost links of small groups.
    rng = np.random.default_rng(19)
    base = rng.normal(size=(10, 16))
    large = np.repeat(base, 300, axis=0) if copies else base[:1] + rng.normal(size=(60, 16)) * 0.02
    pairs = [c + rng.normal(size=16) * 0.02 for c in rng.normal(size=(100, 16)) for _ in range(2)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*large, *pairs])], "vec_id long, embedding array<double>")
    real, calls = flat_graph._linked, []

    def loses_the_pairs(*args):
        calls.append(args[-1])
        return real(*args).where(F.col("rep") < len(large) if len(calls) == 1 else F.lit(True))

    monkeypatch.setattr(flat_graph, "_linked", loses_the_pairs)
    got = {r.vec_id: r for r in flat_graph.near_vectors(df).collect()}
    assert len(calls) == 2 and all(got[i].n_links >= 1 for i in range(len(large), len(got))) and 0.9 <= got[0].audited_recall <= 1


# Fingerprints
def brute_fingerprints(rows):
    """rows (doc_id or None, text or None), by a plain walk in the order of the operator."""
    def folded(text):
        return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())

    order = [(i, t or "") for i, t in rows]
    out = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        new = text[: len(text) - cut] + after[:cut]
        marks = [xxhash.xxh3_128(folded(t).encode()).hexdigest() for t in (text, new, after)]
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), marks[0], marks[1], float(marks[0] == marks[1]), float(marks[0] == marks[2])))
    return out


def test_fingerprints(spark, odd):
    rows = [(i * 3, f"Text  number {i % 4} ÀÉ ﬁ", "s") for i in range(40)] + [(500, None, "s"), (501, "", "s"), (502, "STRASSE", "s"), (503, "straße ", "s"), (504, "İI\u2028x Σς", "s"), (505, "i̇i x σσ", "s")]
    got = fingerprint.fingerprint_documents(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_fingerprints([(i, t) for i, t, _ in sorted(rows, reverse=True, key=lambda r: r[0])]))
    by_id = {r.doc_id: r for r in got}
    assert by_id[502].fingerprint == by_id[503].fingerprint and by_id[504].fingerprint == by_id[505].fingerprint
    assert fingerprint.fingerprint_documents(odd).count() == odd.count() and fingerprint.fingerprint_documents(odd.limit(0)).count() == 0


def test_fingerprints_of_rows_that_share_an_id(spark):
    rows = [(None, f"text {i}", "s") for i in range(300)] + [(5, f"other {i}", "s") for i in range(300)] + [(i, f"own {i}", "s") for i in range(20)] + [(9, "z", "s")] * 3
    docs = docs_of(spark, rows)
    near = fingerprint.neighbours(docs, width=8)
    sizes = [r.n for r in near.where("not guest").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 6 and max(sizes) < 250
    marks = {t: m for t, m in docs.select("text", F.pmod(F.xxhash64("text"), F.lit(fingerprint._SPAN))).collect()}
    order = sorted(rows, key=lambda r: (0 if r[0] is not None else 1, -(r[0] or 0), marks[r[1]], r[1]))
    key = lambda r: (r[0] is None, *r[int(r[0] is None) :])
    assert sorted(map(tuple, fingerprint.fingerprint_documents(docs).collect()), key=key) == sorted(brute_fingerprints([(i, t) for i, t, _ in order]), key=key)


def test_fingerprint_collisions_are_numbered(spark):
    rows = [(1, 1, "", "d", "e", 0.0, 0.0, bytearray(b"a")), (2, 1, "", "d", "d", 1.0, 0.0, bytearray(b"b")), (3, 1, "", "d", "e", 0.0, 0.0, bytearray(b"a")), (4, 1, "", "q", "e", 0.0, 0.0, None)]
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint) for r in fingerprint.verified(spark.createDataFrame(rows, fingerprint._ROW)).collect()}
    assert got == {1: ("d", "e"), 2: ("d-1", "d-1"), 3: ("d", "e"), 4: ("q", "e")}


# Shared parts
def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[k] == 1000 for k in range(1000, 1100)) and 5000 not in got


def test_shingles():
    texts = ["a b c d e f", "a b", "", " x\ty  z ", "a b c d e f g"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    h, s = bytesx.shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets, 5)
    assert np.diff(s).tolist() == [2, 1, 0, 1, 3] and set(h[s[0] : s[1]]) < set(h[s[4] : s[5]])


def test_small_batches_keeps_a_setting_and_changes_no_result(spark):
    docs = spark.createDataFrame([(i, f"call +1 555 010 {i:04d} " * (i % 7)) for i in range(50)] + [(50, None)], "doc_id long, text string")
    given = {}
    for bound in (None, "1k"):
        spark.conf.unset(common.BATCH_SETTING) if bound is None else spark.conf.set(common.BATCH_SETTING, bound)
        given[bound] = sorted(map(tuple, ngram_join.jaccard_join(pii.pseudonymise(docs, "k")).collect()))
        assert spark.conf.get(common.BATCH_SETTING) == (bound or common.BATCH_BYTES)
    spark.conf.unset(common.BATCH_SETTING)
    assert given[None] == given["1k"]
