"""The operators' queries against their SQL, over whole tables."""

import pytest

from folium.llm import queries
from tests.test_against_sql import DATA, cells, db, pytestmark  # noqa: F401

ORACLE = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, db, name):  # noqa: F811
    frame = queries.queries()[name](spark, DATA)
    want = db.sql(ORACLE[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert cells(frame.columns, frame.collect()) == cells(want.columns, want.fetchall())


def test_licences_in_sql_and_spark(spark):
    """Whole licences, notices and identifiers in one table, by the operator and by its SQL."""
    import pathlib

    import duckdb

    from folium.llm import licenses

    files = [p for p in sorted(pathlib.Path("/usr/share/common-licenses").glob("*")) if p.is_file()]
    texts = [p.read_text(errors="replace") for p in files]
    texts += [f"notice\n{t}\nGNU General Public License version 3 or any later version" for t in texts[:3]]
    texts += [None, "", "SPDX-License-Identifier: GPL-3.0+ OR MIT\nApache License", "# SPDX-License-Identifier: none"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    db = duckdb.connect()
    db.register("documents", rows.toPandas())
    want = db.sql(licenses.oracle_sql())
    got = licenses.scan_licenses(rows).drop("spans")
    assert cells(got.columns, got.collect()) == cells(want.columns, want.fetchall())
