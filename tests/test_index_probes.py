"""the default number of probes is set by trial queries, so that recall holds for any number of cells."""

import numpy as np
import pytest

from lumenframe.operators import search as vs


@pytest.mark.parametrize("kind", ["noise", "groups"])
def test_default_probes_reach_the_recall(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12))
    if kind == "groups":
        x = 0.05 * x + rng.normal(size=(39, 12))[rng.integers(0, 39, len(x))]
    df = spark.createDataFrame([(f"v{i}", [float(v) for v in row]) for i, row in enumerate(x)],
                               "id string, embedding array<double>").cache()
    asked = df.filter("substring(id, -1) IN ('0', '5')")
    model, index = vs.build_index(df)
    cells = len(model.clusterCenters())
    probes = vs.trial_probes(model, index, asked)
    exact = vs.search_many(df, asked)
    assert vs.recall(exact, vs.search_index(model, index, asked)).first()["recall"] >= 0.9
    if kind == "groups":
        assert probes < cells / 4
