"""Every stage of the pipeline against a plain version of it, and the whole against its stages."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from acervo.llm import pii, quality
from acervo.llm.common import table

from test_llm_mixing import brute as brute_mix
from test_llm_neardup import brute as brute_components

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output rows of every stage, each read from Parquet."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, SF_DIR, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(folder / str(k)))
        made = spark.read.parquet(str(folder / str(k)))
        out.append((name, docs, made))
        docs = made
    return out


def test_columns(steps):
    want = steps[0][1].columns
    assert [made.columns for _, _, made in steps[:-1]] == [want] * 4


def test_quality(spark, steps):
    _, docs, made = steps[0]
    scored = quality.classified(docs, table(spark, SF_DIR, "labels")).collect()
    assert {r["doc_id"] for r in made.collect()} == {r["doc_id"] for r in scored if r["predicted"] == 1}
    assert 0.7 * docs.count() < made.count() < docs.count()


def test_near_duplicates(steps):
    _, docs, made = steps[1]
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in made.collect()) == sorted(set(want.values()))
    assert made.count() < docs.count()


def test_decontamination(spark, steps):
    _, docs, made = steps[2]
    items = [r["text"] for r in table(spark, SF_DIR, "benchmark").collect()]
    want = {r["doc_id"] for r in docs.collect() if not any(t in r["text"] for t in items)}
    assert {r["doc_id"] for r in made.collect()} == want and len(want) < docs.count()


def test_personal_data(steps):
    _, docs, made = steps[3]
    before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in made.collect()}
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not pii.base_spans(before[k]["text"]):
            assert r["text"] == before[k]["text"]
    assert any(r["text"] != before[k]["text"] for k, r in after.items())


def test_mixing(steps):
    _, docs, made = steps[4]
    got = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in made.collect()), key=repr)
    assert got == brute_mix([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()])


def test_run_equals_the_stages(spark, steps):
    assert sorted(map(tuple, entry.queries()["pipeline"](spark, SF_DIR).collect())) == sorted(map(tuple, steps[-1][2].collect()))


def test_stages_take_empty_tables(spark, steps):
    docs = steps[0][1].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
