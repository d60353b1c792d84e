import os
import random
import time

import pytest

from lakequill.llm import sentencepieces as sp
from lakequill.llm.queries import MODEL_PATH

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL_PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def model():
    return sp.read_model(MODEL_PATH)


def texts():
    rng = random.Random(3)
    out = ["", " ", "  a", "a   b ", "日本語 テスト\n\n\t x", "▁▁a▁b", "\x00x", "😀 ok", "a" * 300, " " * 50 + "x", "Hello  world éé", "the " * 50]
    return out + ["".join(rng.choice("ab éth einß日\n  😀▁THEing") for _ in range(rng.randrange(60))) for _ in range(1500)]


def test_pieces_equal_the_librarys(model):
    import sentencepiece

    mine, theirs = sp.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for t in texts():
        assert mine.encode(t) == theirs.encode(t)
        assert mine.decode(mine.encode(t)) == t.replace("▁", " ")


def test_long_runs_equal_the_librarys(model):
    import sentencepiece

    mine, theirs, rng = sp.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(4)
    began = time.time()
    for t in (" " * 1_000_000, "x" + " " * 99_999 + "the", "a" * 50_000, (" " * 777 + "\n") * 50, " " * 70 + "the\n" + " " * 33):
        assert mine.encode(t) == theirs.encode(t)
    assert time.time() - began < 20 and max(map(len, [*mine.known, *mine.words])) <= sp.LONGEST
    for _ in range(300):
        t = sp.BLANK * rng.randrange(300) + "".join(rng.choice("a▁the▁▁\t") for _ in range(rng.randrange(12)))
        assert mine.blanks_merged(t) == mine.merged(t) == plain_merges(mine, t)


def plain_merges(pieces, text):
    parts = list(text)
    while True:
        scores = [pieces.scores[pieces.ids[a + b]] if a + b in pieces.ids else None for a, b in zip(parts, parts[1:], strict=False)]
        if not [s for s in scores if s is not None]:
            return parts
        k = scores.index(max(s for s in scores if s is not None))
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_unigram_viterbi_is_the_best_path():
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.trainer_spec.model_type = 1
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = False, False, True
    scores = {"<unk>": 0.0, "a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.1, "aba": -4.0, "bab": -7.0}
    for name, score in scores.items():
        m.pieces.add(piece=name, score=score, type=2 if name == "<unk>" else 1)
    pieces = sp.Pieces(m.SerializeToString())

    def best(t):
        if not t:
            return 0.0
        return max((scores[t[:k]] if t[:k] in scores else pieces.lowest) + best(t[k:]) for k in range(1, len(t) + 1) if t[:k] in scores or (k == 1 and t[0] not in scores))

    for t in ("ababab", "bababba", "abxab", "aabbabab"):
        parts = pieces._unigram(t)
        assert "".join(parts) == t and sum(scores.get(p, pieces.lowest) for p in parts) == pytest.approx(best(t))


def test_rows(spark, model):
    docs = spark.createDataFrame([(1, "Hello world", 7), (2, None, 8), (2, "", 9), (None, "x " * 20000, 1)], "doc_id long, text string, N_Pieces int")
    got = sp.encode_documents(docs, model, back="back")
    assert got.columns == ["doc_id", "text", "n_pieces", "piece_ids", "back"] and all(r.back and r.n_pieces == len(r.piece_ids) for r in got.collect())
    back = sp.decode_documents(got, model).collect()
    assert sorted(r.decoded for r in back) == sorted((r.text or "") for r in back)
    assert sp.encode_documents(docs.limit(0), model).count() == 0
