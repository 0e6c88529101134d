"""Fixes at once against the plain loop."""

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkspect.operators.fixes import applied_to, edited, fixed


def test_fixes_take_linear_time_and_equal_the_plain_loop():
    own = random.Random(8)
    for _ in range(400):
        text = "".join(own.choice("aé漢") for _ in range(own.randrange(12)))
        data = text.encode()
        fixes = [(own.randrange(-1, 14), own.randrange(-1, 15), own.choice(["", "x", "ü"])) for _ in range(own.randrange(5))]
        starts, ends = (np.array([f[i] for f in fixes], np.int64) for i in (0, 1))
        new, _, applied, deferred = edited(data, fixes)
        assert applied_to(data, starts, ends, pa.array([f[2] for f in fixes], pa.string())) == (new, applied, deferred)


def test_a_long_text_with_many_fixes(spark):
    n = 60000
    rows = spark.range(1).select(F.expr(f"repeat('ab', {n})").alias("text"), F.expr(f"transform(sequence(0, {n - 1}), i -> struct(int(2 * i) AS start, int(2 * i + 1) AS end, 'xyz' AS replacement))").alias("fixes"))
    begun = time.time()
    r = rows.select(fixed(F.col("text"), F.col("fixes")).alias("r")).first().r
    assert (r.text, r.applied, r.deferred) == ("xyzb" * n, n, 0) and time.time() - begun < 20
