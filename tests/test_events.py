"""Events whose summaries hang on the order in which doubles are summed."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from revscope.plans import event_queries as Q

LOGS = 100


@pytest.fixture(scope="module", params=[(27, 96), (35, 76)])
def events(request, tmp_path_factory):
    """Two logs whose mean throttle step is an exact half: one order of their steps sums to a half, another just below."""
    seed, log = request.param
    r, n = np.random.default_rng(seed), LOGS * 2500
    rows = pd.DataFrame({"event_id": np.arange(n), "user_id": r.integers(0, 1500, n), "value": r.integers(0, 50000, n) / 100})
    folder = tmp_path_factory.mktemp("events")
    rows.to_parquet(folder / "events.parquet", index=False)
    return log, str(folder)


def test_mean_step_of_tip_ins_is_that_of_the_sql(spark, events):
    log, folder = events
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    expected = {r[0]: r[1:] for r in con.execute(f"SELECT log_id, events, avg_dtps FROM ({Q.ORACLES['tipin_summary']})").fetchall()}
    got = {r.log_id: (r.events, r.avg_dtps) for r in Q.QUERIES["tipin_summary"](spark, folder).collect()}
    assert len(got) == LOGS and got[log] == expected[log] and got == expected
