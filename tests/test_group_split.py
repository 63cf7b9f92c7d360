"""The company split against the reference's rule, spelt out on the driver."""

import hashlib
import random
from datetime import datetime, timedelta
from math import floor
from statistics import median

from quaystone.plans import catalogue


def test_four_age_strata_and_largest_remainders(spark, tmp_path):
    rng, observed = random.Random(8), datetime(1998, 9, 1)
    ages = {key: [rng.choice((5, 200, 365, 366, 700, 730, 731, 1000, 1095, 1096, 1400)) for _ in range(rng.randrange(1, 4))] for key in range(1, 104)}
    rows = [(1000 * key + i, key, observed - timedelta(days=age)) for key, found in ages.items() for i, age in enumerate(found)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    strata, expected = {}, {}
    for key, found in ages.items():
        months = median(found) / (365.25 / 12)
        strata.setdefault(sum(months > edge for edge in (12, 24, 36)), []).append((hashlib.sha256(f"20260619\0{key}".encode()).hexdigest(), key))
    for companies in strata.values():
        raw = [share * len(companies) for share in (0.6, 0.15, 0.1, 0.15)]
        counts = [floor(x) for x in raw]
        for k in sorted(range(4), key=lambda k: -(raw[k] - counts[k]))[: len(companies) - sum(counts)]:
            counts[k] += 1
        names = [name for name, count in zip(("train", "validation", "calibration", "test"), counts) for _ in range(count)]
        expected |= {key: name for (_, key), name in zip(sorted(companies), names)}
    assert len(strata) == 4
    assert {r.o_custkey: r.split for r in catalogue.QUERIES["group_split"](spark, str(tmp_path)).collect()} == expected
