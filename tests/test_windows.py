"""Windows that close: bounded state, every late row in one of two outputs, batches that are run again."""

import random
from collections import Counter

import pytest

from casewright.sources.tables import ChangingTable
from casewright.streaming.windows import WindowCounts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_state_ends_and_no_row_is_lost(spark, tmp_path):
    rng = random.Random(4)
    counts, at, seen, widest = WindowCounts(spark, str(tmp_path), 10, 25), 0, [], 0
    mark, kept, missed = None, Counter(), []
    for batch in range(12):
        made = [(rng.choice("ab"), 100 * batch + k, max(0, 60 * batch + rng.randrange(60) - rng.choice([0, 0, 0, 20, 300]))) for k in range(30)]
        seen += made
        for key, row, us in made:
            start = us // 10 * 10
            if mark is not None and start + 10 <= mark:
                missed.append((row, key, us))
            else:
                kept[key, start] += 1
        mark = max(mark or -(10**9), max(us for _, _, us in made) - 25)
        counts.put(spark.createDataFrame(made, "key string, row long, us long"), batch)
        counts.put(spark.createDataFrame(made, "key string, row long, us long"), batch)  # again
        widest = max(widest, counts.open.read().count())
    assert rows(counts.missed.read()) == sorted(missed) and missed
    assert rows(counts.closed.read()) == sorted((k, s, n) for (k, s), n in kept.items() if s + 10 <= mark)
    assert rows(counts.open.read()) == sorted((k, s, n) for (k, s), n in kept.items() if s + 10 > mark)
    assert sum(kept.values()) + len(missed) == len(seen) and widest <= 2 * (25 // 10 + 2)


def test_a_batch_that_was_broken_off_goes_on(spark, tmp_path, monkeypatch):
    made = spark.createDataFrame([("a", 1, 5), ("a", 2, 50), (None, 3, None)], "key string, row long, us long")
    put = ChangingTable.put
    for steps in (1, 2, 3):
        counts, done = WindowCounts(spark, f"{tmp_path}/{steps}", 10, 20), []

        def fails(self, *a, done=done, steps=steps, **b):
            if len(done) == steps:
                raise OSError("lost")
            done.append(1)
            return put(self, *a, **b)

        monkeypatch.setattr(ChangingTable, "put", fails)
        with pytest.raises(OSError):
            counts.put(made, 0)
        monkeypatch.setattr(ChangingTable, "put", put)
        counts.put(made, 0)
        assert rows(counts.closed.read()) == [("a", 0, 1)] and rows(counts.open.read()) == [("a", 50, 1)] and [r.row for r in counts.missed.read().collect()] == [3]
