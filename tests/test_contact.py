"""Contact at the limit itself, where the order of subtractions decides."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from spoorline.plans import catalogue


def test_contact_at_the_limit_follows_the_sql(spark, tmp_path):
    rows = [(1, 4, 69.88, 70), (2, 5, 63.88, 70), (3, 4, 10.5, 3), (4, 5, 60.25, 9)]
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r[0]) for r in rows]
    table = pa.table({"event_id": [r[0] for r in rows], "ts": pa.array(at, pa.timestamp("us")), "user_id": [r[1] for r in rows], "event_type": ["view"] * 4, "value": [r[2] for r in rows], "props": [f'{{"k": {r[3]}}}' for r in rows]})
    pq.write_table(table, tmp_path / "events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = sorted(duck.execute(catalogue.oracle_sql()["contact_semantics"]).fetchall())
    got = sorted(tuple(r) for r in catalogue.queries()["contact_semantics"](spark, str(tmp_path)).collect())
    assert got == want and {r[5] for r in want} == {0.0, 1.0}
