"""Each query of the problems runs on the smallest tables; those with SQL agree with it."""

import pytest

from inkwell.llm import queries
from tests.conftest import compare

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, sf_dir, name):
    compare(spark, duck, sf_dir, QUERIES[name], SQL[name])


COLUMNS = {
    "p1_found": "row_id bigint, field string, defect string", "p2_found": "tbl string, field string, rec_key string", "p3_found": "tbl string, rec_key string, line_no int, kind string",
    "p4_found": "tbl string, rec_key string, end_pos int", "p5_found": "tbl string, rec_key string, cut string", "p7_found": "doc_id bigint, item_id bigint", "p8_found": "doc_id bigint, lang string",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir).persist()
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    assert df.count() == df.distinct().count()


def test_unit_ends_agree_with_items(spark, sf_dir):
    """The items of structured results are their sentence units."""
    from inkwell.llm.sentences import unit_ends

    right = wrong = 0
    for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/loader_results.parquet").where("items is not null").select("content", "items").collect():
        places = [i for i, ch in enumerate(r.content) if not ch.isspace()]
        flat, at, ends = "".join(r.content[i] for i in places), 0, set()
        for item in r["items"]:
            text = "".join(item.text.split())
            at = flat.find(text, at) + len(text)
            ends.add(places[at - 1] + 1)
        got = set(unit_ends(r.content))
        right += len(got & ends)
        wrong += len(got ^ ends)
    assert right > 1000 and wrong <= 0.01 * right
