"""Edits merged before they are judged, against SQL."""

import duckdb
import pytest

from fathomline.plans import all_queries


@pytest.mark.parametrize("name", ["po6_source_edits"])
def test_edits_of_one_text_and_place_from_different_parts(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql("create table part as select * from (values (1, 3, 'B1'), (1, 38, 'B1'), (1001, 3, 'B1'), (2, 5, 'B2'), (2, 40, 'B2'), (3, 4, 'B1')) t(p_partkey, p_size, p_brand)")
    con.sql(f"copy (select p_partkey::BIGINT p_partkey, p_size, p_brand from part) to '{tmp_path}/part.parquet' (format parquet)")
    got = sorted(map(tuple, all_queries.QUERIES[name](spark, str(tmp_path)).select("file", "start", "end", "text", "rejected").collect()))
    assert got == sorted(con.sql(f'select file, start, "end", text, rejected from ({all_queries.SQL[name]})').fetchall()) and len(got) == 5
