"""What the operators need not do twice."""

import numpy as np
from pyspark.sql import Row, functions as F

from lexweave.llm import bloom_lm, passages, text as tx


def test_levels_asked_before_are_not_asked_again(monkeypatch):
    names = np.unique(tx.mix(np.arange(1, 5001, dtype=np.uint64)))
    counts = np.random.default_rng(3).integers(1, 400, len(names))
    raw = bloom_lm.segment(names, counts).tobytes()

    def fresh():
        return bloom_lm.Filter(np.zeros(1, np.int64), np.array([len(raw) * 8], np.uint64), raw)

    held, asked, real = fresh(), [], bloom_lm.Filter._asked_for
    monkeypatch.setattr(bloom_lm.Filter, "_asked_for", lambda self, x: (asked.append(len(x)), real(self, x))[1])
    some = names[::3]
    assert (held.levels(some) == fresh().levels(some)).all()
    asked.clear()
    again = held.levels(names)
    assert asked[0] < len(names) - 0.8 * len(some)
    assert (again == fresh().levels(names)).all()
    monkeypatch.setattr(bloom_lm, "KEPT_NAMES", 0)
    assert (fresh().levels(names) == again).all()


def test_buckets_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Buckets of one unit, two, and more, with the first unit of each; found with a single exchange."""
    plans, real = [], passages.durable
    monkeypatch.setattr(passages, "durable", lambda df: (plans.append((df.columns, df)), real(df))[1])
    units = spark.createDataFrame([Row(unit=u, bands=b) for u, b in [(1, [10, 20]), (2, [10, 30]), (3, [10, 20]), (4, [40]), (5, [10])]])
    sets = spark.createDataFrame([Row(unit=u, shingles=[u * 10, u * 10 + 1]) for u in range(1, 6)])
    passages.linked(units, lambda asked: sets, f"file://{tmp_path}/f", 0.8).count()
    members = next(df for columns, df in plans if set(columns) == {"bucket", "unit", "first", "size"})
    found = {(r["bucket"], r["unit"], r["first"], r["size"]) for r in members.collect()}
    assert found == {(10, u, 1, 3) for u in (1, 2, 3, 5)} | {(20, 1, 1, 2), (20, 3, 1, 2)}
    assert members._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
