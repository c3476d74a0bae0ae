"""Products with a matrix whose rows are dealt to parts."""

import numpy as np

from gridstone import state
from gridstone.operators import krylov


def test_least_squares_writes_no_rows(spark, monkeypatch):
    sizes, put = [], state.Slot.put
    monkeypatch.setattr(state.Slot, "put", lambda self, df: (t := put(self, df), sizes.append(t.count()))[0])
    rng = np.random.default_rng(2)
    m, b = rng.normal(size=(40, 2)), rng.normal(size=41)
    rows = [(r, c, float(m[r, c])) for r in range(40) for c in (0, 1)]
    x, _ = krylov.least_squares(spark.createDataFrame([*rows, (0, 0, 1.0), (3, 1, None)], "r long, c long, v double"), spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, v double"))
    m[0, 0] += 1.0
    assert np.allclose([r.v for r in x.orderBy("i").collect()], np.linalg.lstsq(m, b[:40], rcond=None)[0], atol=1e-6)
    assert max(sizes) <= 3  # columns and a length; a vector of all rows in each step before
