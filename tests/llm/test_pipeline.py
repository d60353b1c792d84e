import os

import duckdb
import pytest

from lakequill.llm import ngram_join, pii, quality, sentencepieces
from lakequill.llm import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as cp

    docs = q.table(spark, SF, "documents")
    labels = q.table(spark, SF, "labels")
    kept, columns = {}, docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(cp.STAGES) - 1 or out.columns == columns
        before = {r.doc_id: r for r in docs.collect()}
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = after = docs.collect()
        ids = {r.doc_id for r in after}
        if name == "quality":
            model = quality.fit(q.table(spark, SF, "documents"), labels)
            assert ids == {r.doc_id for r in quality.score(q.table(spark, SF, "documents"), model).where("keep").collect()}
        if name == "near_duplicates":
            rows = spark.createDataFrame(list(before.values()))
            assert len(after) == len(ids) == len({r.component_id for r in ngram_join.jaccard_join(rows).collect()})
        if name == "pii":
            names = pii.Pseudonyms(q.pii_key(spark).encode())
            assert all(r.text == names.text(before[r.doc_id].text) for r in after)
        if name == "mixing":
            assert ids <= set(before) and max(sum(r.doc_id == i for r in after) for i in ids) <= 3
        if name == "sentencepiece":
            pieces = sentencepieces.Pieces(sentencepieces.read_model(q.MODEL_PATH))
            assert all(pieces.decode(r.piece_ids) == r.text for r in after)
    assert sorted(r.doc_id for r in cp.run(spark, SF).collect()) == sorted(r.doc_id for r in kept["sentencepiece"])


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = c.execute(q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = q.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    mine = sorted(repr([r[n] for n in names]) for r in df.collect())
    assert mine == sorted(repr(list(r)) for r in found.fetchall())
