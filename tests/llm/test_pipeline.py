"""The pipeline's stages, each against a plain restatement of its decision on its own input."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from cardloom.llm import queries
from cardloom.plans.session import stage
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, function in cp.STAGES:
        after = stage(function(spark, docs, FOLDER))
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_stage_names_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    assert all(sorted(c) == sorted(cp.COLUMNS) for _, _, c in steps[:-1])
    assert all(r["n_chars"] == len(r["text"]) for _, after, _ in steps[1:2] for r in after)


def test_quality_keeps_clean_documents(steps):
    before, after, _ = steps[0]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not brute.measures(r["text"])[-1])


def test_line_dedup_keeps_documents_and_whole_lines(steps):
    before, after, _ = steps[1]
    was = {r["doc_id"]: r["text"].split("\n") for r in before}
    assert len(before) == len(after)
    for r in after:
        left = iter(was[r["doc_id"]])
        assert all(x in left for x in r["text"].split("\n"))


def test_one_of_each_class_stays(steps):
    before, after, _ = steps[2]
    roots = brute.jaccard_classes({r["doc_id"]: r["text"] for r in before})
    assert sorted(r["doc_id"] for r in after) == sorted(set(roots.values()))


def test_mix_repeats_no_document_more_than_twice(steps):
    before, after, _ = steps[3]
    times = Counter(r["doc_id"] for r in after)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        n = len(brute.words(r["text"]))
        sizes[r["source"]] += n
        taken[r["source"]] += n * times[r["doc_id"]]
    want, longest = brute.targets(sizes), max(len(brute.words(r["text"])) for r in before)
    assert max(times.values()) <= 2 and all(abs(taken[s] - want[s]) <= longest for s in sizes)


def test_packing_takes_every_token(steps):
    before, after, _ = steps[4]
    times = Counter(r["doc_id"] for r in before)
    total = Counter()
    for r in after:
        total[r["doc_id"]] += r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in after}
    assert total == Counter({i: n * tokens[i] for i, n in times.items()})


def test_run_equals_the_stages(spark, steps):
    got = Counter((r["doc_id"], r["start"], r["length"]) for r in cp.run(spark, FOLDER).collect())
    assert sum(n * k[2] for k, n in got.items()) == sum(r["length"] for r in steps[4][1])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_rows(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0
