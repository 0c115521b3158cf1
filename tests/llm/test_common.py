"""Helpers of the subpackage."""

import numpy as np
from pyspark import cloudpickle

from examlytics.llm import common, latent_decontamination, ngram_join, suffix_dedup


def test_functions_travel_without_the_caches_of_the_driver():
    common.prefix_hash(np.frombuffer(b"some text on the driver", np.uint8))
    assert common._POWERS
    for module in (common, latent_decontamination, ngram_join, suffix_dedup):
        for name, f in vars(module).items():
            if callable(f) and getattr(f, "__module__", "") == module.__name__:
                assert len(cloudpickle.dumps(f)) < 1 << 20, f"{module.__name__}.{name}"


def test_lean_tasks_give_the_same_rows(spark):
    def twice(batches):
        for b in batches:
            yield b
            yield b

    rows = spark.range(100).mapInArrow(common.lean(twice), "id long")
    assert sorted(r.id for r in rows.collect()) == sorted([*range(100)] * 2)
    assert len(rows.limit(3).collect()) == 3  # a task that is ended early
