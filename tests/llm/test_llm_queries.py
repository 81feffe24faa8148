"""The queries of this package: against their SQL, and by their own properties where SQL cannot say it."""

import pytest

from strandline.llm import catalogue
from strandline.sources import table


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_sql(name, same_as_sql):
    same_as_sql(catalogue.QUERIES[name], catalogue.SQL[name])


def _pandas(name, spark, small):
    return catalogue.QUERIES[name](spark, small).toPandas()


def test_garbled_rows_are_restored_to_other_texts(spark, small):
    found, restored = _pandas("p3_found", spark, small), _pandas("p3_restored", spark, small)
    assert len(restored) and set(found.itertuples(index=False, name=None)) == set(zip(restored.table_name, restored.row_id))
    known = restored[restored.restored.notna()]
    assert len(known) > 0.8 * len(restored) and (known.value != known.restored).all() and not known.restored.str.contains("\ufffd").any()
    assert not restored.duplicated(["table_name", "row_id"]).any()


def test_files_have_one_kind_each(spark, small):
    found, kinds = _pandas("p4_found", spark, small), _pandas("p4_kinds", spark, small)
    assert set(found.row_id) == set(kinds.row_id) and not kinds.row_id.duplicated().any()
    assert set(kinds.kind) == {"vendored", "generated", "minified", "data"}


def test_unmatched_names_are_those_without_an_entry(spark, small):
    found, unmatched = _pandas("p7_found", spark, small), _pandas("p7_unmatched", spark, small)
    assert unmatched.n_rows.sum() == (found.package_id == 0).sum() > 0


def test_sizes_are_those_of_the_ids(spark, small):
    ids, sizes = _pandas("p8_ids", spark, small).set_index("doc_id").ids, _pandas("p8_sizes", spark, small).set_index("doc_id").n_ids
    assert len(ids) == len(sizes) == table(spark, small, "documents").count()
    assert (ids.map(len) == sizes[ids.index]).all()


def test_mix_agrees_with_its_report(spark, small):
    mix, report = _pandas("p9_mix", spark, small), _pandas("p9_report", spark, small)
    target = table(spark, small, "mix_target").toPandas().set_index("source")
    assert set(report.source) == set(target.index) and report.share.sum() == pytest.approx(1)
    sums = (mix.n_ids * mix.copies).groupby(mix.source).sum()
    for r in report.itertuples():
        assert sums.get(r.source, 0) == r.chosen <= r.budget + 1e-6 and r.weight == pytest.approx(target.weight[r.source])
        assert mix[mix.source == r.source].copies.max() <= target.max_repeat[r.source] or not r.chosen
        assert r.short == (r.shortfall > 0)


def test_sentences_lie_in_repeated_passages(spark, small):
    runs, found = _pandas("p10_passages", spark, small), _pandas("p10_sentences", spark, small)
    runs = runs[runs.kind == "repeated"]
    assert len(found)
    for r in found.itertuples(index=False):
        own = runs[runs.doc_id == r[0]]
        assert ((own["from"] <= r[1]) & (own["to"] >= r[2])).any()


def test_columns_are_those_fixed(spark, small):
    want = {"p2_found": ["field", "term", "mark"], "p3_found": ["table_name", "row_id"], "p4_found": ["row_id"], "p5_found": ["package", "stringidentifier"], "p7_found": ["field", "row_id", "package_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_a", "doc_b"]}
    for name, columns in want.items():
        assert catalogue.QUERIES[name](spark, small).columns == columns, name


def test_every_name_has_an_answer(spark, small):
    found = catalogue.QUERIES["p7_found"](spark, small)
    named = sum(table(spark, small, t).where(f"{c} is not null").count() for t, c in (("processed", "package"), ("renames", "originalname"), ("renames", "newname")))
    assert found.count() == named == found.select("field", "row_id").distinct().count()
    assert found.where("package_id is null").count() == 0
