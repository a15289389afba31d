"""Steps that hold no more than their result needs."""

import gc
import math
import random
import weakref
from itertools import combinations

import pandas as pd

from lodespark.operators import itemsets
from lodespark.streaming import live


def test_candidates_of_parts_by_enumeration(spark):
    random.seed(2)
    rows = [(k, i) for k in range(60) for i in "abcdefg" if random.random() < 0.5] * 2 + [(k, None) for k in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "k int, i string").selectExpr("k", "i", "k % 3 part")
    for size in (1, 2, 3):
        want = set()
        for part in range(3):
            baskets = [{i for k, i in rows if k == b} for b in {k for k, _ in rows if k % 3 == part}]
            need = max(1, math.ceil(15 * len(baskets) / 60))
            names = ["a", "b", "c", "d", "e", "f", "g", *([None] if size == 1 else [])]
            want |= {c for c in combinations(names, size) if sum(set(c) <= b for b in baskets) >= need}
        got = itemsets.son_candidates(df, "k", "i", "part", 15, size).collect()
        assert {tuple(r["items"]) if size > 2 else tuple(r) for r in got} == want and len(got) == len(want)


def test_matches_of_baskets_are_not_written(spark, monkeypatch):
    names = []
    real = itemsets.written
    monkeypatch.setattr(itemsets, "written", lambda df, name, **k: names.append(name) or real(df, name, **k))
    df = spark.createDataFrame([(k, i) for k in range(4) for i in "abcd"], "k int, i string").selectExpr("k", "i", "k % 2 part")
    assert itemsets.son_candidates(df, "k", "i", "part", 2, 3).count() == 4 and set(names) == {"baskets", "level"}


class _State:
    exists, get = False, None

    def update(self, saved):
        self.exists, self.get = True, saved


def test_bloom_state_holds_new_keys_alone():
    """Frames come one after the other and none is kept; their order does not matter."""
    results = []
    for order in ([0, 50, 100], [100, 0, 50]):
        came = []

        def frames(starts):
            for start in starts:
                gc.collect()
                assert sum(r() is not None for r in came) <= 1
                at = range(start, start + 50)
                f = pd.DataFrame({"seq": at, "tick": [s // 20 for s in at], "key": [str(s % 30) for s in at], "bits": [[s % 30 * 7 + j for j in range(10)] for s in at]})
                came.append(weakref.ref(f))
                yield f

        state = _State()
        results.append(sorted(map(tuple, next(live._bloom_state((0,), frames(order), state)).itertuples(index=False))))
        again = next(live._bloom_state((0,), frames([150]), state))
        assert again["fp"].sum() == again["tn"].sum() == 0
    assert results[0] == results[1] and len(results[0]) == 8 and sum(r[2] + r[3] for r in results[0]) == 30


def test_a_tick_is_one_row_of_state(spark, tmp_path, monkeypatch):
    """The live estimate of a tick keeps all its maxima in one row."""
    from pyspark.sql import functions as F

    rows = []
    real = live.drained
    monkeypatch.setattr(live, "drained", lambda s, mode, *k: rows.append(real(s, mode, *k)) or rows[-1])
    spark.range(90).selectExpr("id AS event_id", "id % 11 AS user_id", "cast('2020-01-01' AS timestamp_ntz) AS ts").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stream = live.event_stream(spark, str(tmp_path / "events.parquet"), "*.parquet")
    got = live.live_flajolet_martin(stream, F.floor(F.col("event_id") / 30), "user_id").collect()
    assert len(got) == 3 and len({r.estimate for r in got}) == 1 and rows[0].count() == 3
