"""Rounded means of the policy diff against its SQL, on groups whose means lie at a half."""

import duckdb

import __spark_entry__ as se


def test_means_at_a_half_round_like_the_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select * from read_parquet('/root/testdata/sf0.1/events.parquet') where user_id between 600 and 1000) "
                f"to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    names = ["run_id", "round", "field", "old", "new"]
    got = sorted(tuple(r[c] for c in names) for r in se.queries()["policy_diff"](spark, str(tmp_path)).collect())
    want = sorted(con.execute(f"select {', '.join(names)} from ({se.oracle_sql()['policy_diff']})").fetchall())
    assert got == want
