"""Every plan against its SQL oracle, on the smallest driver tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from claimgraph.operators import ranking, verification
from claimgraph.plans import registry, sample_expected, sample_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


def rows_of(records, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_plan_equals_oracle(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of([r.asDict() for r in got.collect()], sorted(got.columns)) == rows_of(want.to_dict("records"), sorted(got.columns))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_short_quotations_are_found(spark):
    artifacts = spark.createDataFrame([(1, "aa bb cc dd"), (2, "xbb c")], "doc_id long, text string")
    quotes = spark.createDataFrame([(7, "bb c"), (8, "bb cc dd"), (9, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.char_start) for r in verification.verify_quotations(artifacts, quotes).collect()}
    assert found == {(1, 7, 3), (1, 8, 3), (2, 7, 1)}


def test_budget_skips_and_never_cuts(spark):
    spans = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 4), ("a", 4, 1)], "g string, o int, n int")
    assert ranking.budget_fit(spans, "g", "o", "n", limit=2, budget=10).first().kept == "1,3"


def test_structural_verdicts_cover_every_pair(spark, tmp_path):
    """Keys whose last digits differ, as most do."""
    tables = {"part": ([(1,), (2,), (30,)], "p_partkey long"), "supplier": ([(5,), (7,)], "s_suppkey long"), "lineitem": ([(1, 1, 7), (1, 2, 5), (2, 2, 5), (3, None, 5)], "l_orderkey long, l_partkey long, l_suppkey long")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(map(tuple, registry.queries()["structural_check_all"](spark, str(tmp_path)).collect()))
    assert got == [(1, 5, "EXPLICIT_CONTRADICTION"), (1, 7, "SUPPORTED"), (2, 5, "SUPPORTED"), (2, 7, "EXPLICIT_CONTRADICTION"), (30, 5, "NOT_ESTABLISHED")]


def test_structural_verdicts_support_all_order_lines(spark, sf_dir):
    supported = registry.queries()["structural_check_all"](spark, sf_dir).where("verdict = 'SUPPORTED'")
    assert supported.count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().count()


def test_admission_reads_whole_texts(spark, tmp_path):
    """A DOCTYPE behind a long comment, a long plain text, and the limit in bytes."""
    limit = 8 * 1024 * 1024
    documents = [(1, "x" * 20001), (2, "é" * (limit // 2)), (3, "é" * (limit // 2) + "x"), (4, None), (5, "a\0b")]
    pages = [(1, "<!-- " + "licence " * 100 + "-->\n<!doctype html>"), (2, "<!DOCTYPE html>"), (3, "<p>")]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.kind, r.id): r.status for r in registry.queries()["admission_status_all"](spark, str(tmp_path)).collect()}
    assert got == {("document", 1): "ADMITTED", ("document", 2): "ADMITTED", ("document", 3): "OVERSIZE", ("document", 4): "NOT_A_FILE", ("document", 5): "BINARY_AS_TEXT", ("page", 1): "HOSTILE_MARKUP", ("page", 2): "HOSTILE_MARKUP", ("page", 3): "ADMITTED"}


def test_recorded_rows_have_the_outcomes_that_cases_name():
    rows = {name: sorted(map(tuple, found), key=repr) for name, (_, found) in sample_expected.EXPECTED.items()}
    same = lambda name, want: rows[name] == sorted(map(tuple, want), key=repr)
    assert same("evidence_kinds", [(c[0], c[5], c[5] is not None) for c in sample_queries.EVIDENCE_CASES])
    assert same("value_cases", [(i, c[2]) for i, c in enumerate(sample_queries.VALUE_CASES)])
    assert same("decide_questions", [(q[0], q[2], q[3]) for q in sample_queries.QUESTIONS])
    assert same("structural_verdicts", sample_queries.STRUCTURAL_CASES)
    assert same("scope_resolution", sample_queries.SCOPES)
    replies = sample_queries._replies({"shop.core.price": "", "shop.core.helper": "", "shop.core.Cart.TIMEOUT": ""})
    assert [r[:2] for r in rows["answers_validated"]] == [(r[0], r[2]) for r in replies]
