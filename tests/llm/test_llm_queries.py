"""The operators' queries against their SQL, and the pipeline's stages, on the smallest tables."""

import oracle
import pytest

import corpus_pipeline
from commitlens.llm import langid, mixing, secrets
from commitlens.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    if ORACLES[name] is not None:
        oracle.same(QUERIES[name](spark, oracle.SF), oracle.duck(), ORACLES[name])


def test_names():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "12 34", "en", "s", 5), (10**6 + 1, None, None, None, None)], docs.schema)
    at = docs.unionByName(odd)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, oracle.SF)
        path = str(tmp_path / str(i))
        out.write.parquet(path)
        before, at = at, spark.read.parquet(path)
        if i < 4:
            assert at.columns == docs.columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        now = {r.doc_id for r in at.select("doc_id").collect()}
        assert now <= ids
        if i == 0:
            assert ids - now == {10**6, 10**6 + 1}
        if i == 2:
            assert now == ids and secrets.scan(at).where("n_assign + n_hex > 0").count() == 0
        if i == 3:
            taken = {r.doc_id for r in mixing.mix(before, budget=corpus_pipeline.MIX_BUDGET).where("selected").collect()}
            assert now == taken
        if i == 4:
            assert now == ids and at.where("not is_exact").count() == 0
    assert langid.UND == "und"


def test_near_copies_between_the_bounds_go(spark):
    base = [f"w{i}" for i in range(200)]
    copy = [f"x{i}" if i in (30, 80, 130, 180) else w for i, w in enumerate(base)]
    far = [f"y{i}" if i % 30 == 5 else w for i, w in enumerate(base)]
    texts = [" ".join(x) for x in (base, copy, far)]
    sets = [[{tuple(t.split()[i : i + k]) for i in range(201 - k)} for t in texts] for k in (5, 4)]
    like = [[len(a[0] & x) / len(a[0] | x) for x in a[1:]] for a in sets]
    assert like[0][0] >= 0.8 and like[1][0] < 0.85 and like[0][1] < 0.8  # by five words a copy, by op5's bound none
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, df, oracle.SF).collect()} == {0, 2}
