"""op6: copies of the query's vector stay candidates though the rotated values differ by rounding."""

import numpy as np
import pandas as pd
import pytest

from lumenframe.llm import neighbours


@pytest.mark.parametrize("length", [1.0, 1e9])
def test_copies_of_the_query_stay(length):
    rng = np.random.default_rng(5)
    d, k, n = 64, 10, 400
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    q = rng.normal(size=d) * length
    rotated = np.tile(q @ rotation, (n, 1))
    rotated[200:] *= 1 + 4e-16 * rng.choice([-1, 1], size=(200, d))  # a last bit, as a product over a batch may round
    assert len(neighbours.scan(rotated, q @ rotation, k + 1)) == n
    ids = np.arange(n)[::-1]  # the smallest ids come last
    vectors = pd.DataFrame({"id": ids, "v": [q] * n, "rotated": list(rotated)})
    found = neighbours._searcher(k, rotation)(vectors, pd.DataFrame({"id": [-1], "v": [q]}))
    assert found["vec_id"].tolist() == list(range(k)) and (found["score"] == 0).all()
