"""The registered queries at sf0.01: DuckDB twins, and the pipeline against its stages' brute-force forms."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from llm_fixtures import jaccard_classes
from oracle_check import compare, duck
from ratelens.llm import queries, substring_lines

SF = "/root/testdata/sf0.01"


def rows(name):
    return duckdb.connect().execute(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twins(spark, name):
    out = compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE[name])
    assert out["values_match"], out


def test_registered():
    names = set(entry.queries())
    assert {f"op{k}" for k in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def test_ngram_join(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.ngram_join(spark, SF).collect()}
    assert got == jaccard_classes(rows("documents"), 3, 90)


def test_pipeline(spark):
    """Every stage on all that its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        before = [tuple(r) for r in docs.collect()]
        out = out.cache()
        kept[name] = [tuple(r) for r in out.collect()]
        if name == "near_duplicates":
            want = {k for k, (_, c) in jaccard_classes(before, 5, 80).items() if k == c}
            assert {r[0] for r in kept[name]} == want
        if name == "repeated_passages":
            # of a passage of over 50 words that repeats, one document keeps all
            words = {r[0]: substring_lines.WORDS.findall(r[1].lower()) for r in kept[name]}
            homes = {}
            for doc, w in words.items():
                for k in range(len(w) - 50):
                    homes.setdefault(tuple(w[k : k + 51]), set()).add(doc)
            assert all(len(x) == 1 or len(set(run)) < 25 for run, x in homes.items())
            first = {r[0]: r[1] for r in before}
            assert set(words) <= set(first) and sum(first[d] == t for d, t, *_ in kept[name]) >= 0.8 * len(first)
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in last} == {r[0] for r in kept["personal_data"]}
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in last)


def test_clean_documents_stay(spark):
    good = {r[0] for r in rows("labels") if r[1] == 1 and r[2] == 0}
    out = {r["doc_id"]: r for r in queries.quality_rules(spark, SF).collect()}
    candidates = [i for i in good if not out[i]["base_failed"]]
    assert sum(out[i]["kept"] for i in candidates) >= 0.99 * len(candidates)
    bad = [i for i in out if i in {r[0] for r in rows("labels") if r[1] == 0} and not out[i]["base_failed"]]
    assert sum(out[i]["kept"] for i in bad) <= 0.1 * len(bad)
