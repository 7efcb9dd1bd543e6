"""Queries on photos whose capture numbers are longer than the six digits of their file names."""

import os

import pytest

from skysurvey.plans import catalog
from tests.compare import SF, connection, duck_rows, spark_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    made = tmp_path_factory.mktemp("long")
    con = connection()
    for name in os.listdir(SF):
        if name != "orders.parquet":
            (made / name).symlink_to(f"{SF}/{name}")
    con.execute(f"COPY (SELECT * REPLACE (o_orderkey + i * 4999500 AS o_orderkey) FROM range(0, 2) r(i), orders ORDER BY hash(o_orderkey)) TO '{made}/orders.parquet' (FORMAT parquet)")
    return str(made)


@pytest.mark.parametrize("name", ["photo_masks", "epoch_photos", "outside_steps", "nvm_rewrite", "reconstruction_text"])
def test_long_numbers_match_sql(spark, folder, name):
    assert spark_rows(catalog.QUERIES[name](spark, folder)) == duck_rows(connection(folder), catalog.ORACLE_SQL[name])


def test_run_orders_break_ties_by_number(spark, folder):
    sql = catalog.ORACLE_SQL["run_orders"].replace("width DESC, filename)", "width DESC, filename, ord)").replace("ORDER BY filename)", "ORDER BY filename, ord)")
    assert spark_rows(catalog.QUERIES["run_orders"](spark, folder)) == duck_rows(connection(folder), sql)
