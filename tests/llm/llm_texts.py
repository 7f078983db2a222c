"""Made-up texts."""

import numpy as np


def words(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("w%d" % x for x in rng.integers(0, 5000, n))
