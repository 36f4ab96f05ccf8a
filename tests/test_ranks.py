"""Even slices: right ranks, and a share of the values for each slice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.functions import ranks
from fieldcast.operators.association import adjusted_pvalues


def table(spark, groups):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double")


def test_log_uniform_values_spread(spark):
    rng = np.random.default_rng(3)
    values = 10.0 ** rng.uniform(-40, 0, 60_000)
    counted = table(spark, {"a": values}).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    sizes = sorted(r["count"] for r in ranks.sliced(counted, ["g"], "v", even=True).groupBy("g", "_b1").count().collect())
    assert len(sizes) > 500 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    wide = ranks.sliced(counted, ["g"], "v").groupBy("g", "_b1").count().agg(F.max("count")).first()[0]
    assert wide > 100 * sizes[len(sizes) // 2]  # slices of equal width hold nearly all in one


@pytest.mark.parametrize("keys", [["g"], []])
def test_ranks_do_not_depend_on_the_cuts(spark, keys):
    rng = np.random.default_rng(4)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1.0, 1.0, np.nextafter(1, 0), np.nextafter(1, 2), 1.7e308, -1.7e308, 2.0, 2.0, 4.0]
    groups = {"a": [*odd, *(rng.choice([-1, 1], 500) * 10.0 ** rng.uniform(-300, 300, 500)), *np.round(rng.normal(size=500), 1)], "b": [3.0] * 7}
    df = table(spark, groups)
    wanted, found = (
        {(*[r[k] for k in keys], r.v): (r.n, r.n_upto, r.n_total) for r in ranks.rank_counts(df, keys, "v", even=even).collect()}
        for even in (False, True)
    )
    assert found == wanted
    pool = {g: np.sort(v) for g, v in groups.items()} if keys else {(): np.sort(np.concatenate(list(groups.values())))}
    for key, (n, upto, total) in found.items():
        values = pool[key[0]] if keys else pool[()]
        assert (n, upto, total) == ((values == key[-1]).sum(), (values <= key[-1]).sum(), len(values))


def test_adjusted_values_of_tiny_p(spark):
    rng = np.random.default_rng(9)
    p = np.concatenate([10.0 ** rng.uniform(-40, -3, 300), rng.uniform(size=300), [0.0, 1.0, 1.0]])
    found = {r.v: r.p_adj for r in adjusted_pvalues(table(spark, {"a": p}), ["g"], "v").collect()}
    order = np.argsort(p, kind="stable")[::-1]
    wanted, least = {}, 1.0
    for at, k in enumerate(order):
        least = min(least, p[k] * len(p) / (len(p) - at))
        wanted[p[k]] = least
    assert found == pytest.approx(wanted, rel=1e-12)
