"""Fields of bus frames from sums over their bits, against each field worked out for itself."""

import math
import random

import pytest

from tidemark.operators import frames as fr


def value(data, byte, little, shift, bits):
    a, b = data[byte], data[byte + 1]
    return None if a is None or b is None else ((a + b * 256 if little else a * 256 + b) >> shift) % (1 << bits)


@pytest.mark.parametrize("rows, held", [(5, 500), (5, 1), (10_000, 500)])
def test_fields_by_their_bits(spark, monkeypatch, rows, held):
    monkeypatch.setattr(fr, "HELD", held)
    rng = random.Random(rows)
    pairs = []
    for i in range(160):
        size, byte = rng.choice([2, 3, 4]), lambda: None if rng.random() < 0.1 else rng.randrange(256)
        x = None if i % 4 == 0 else float(rng.randrange(5, 120))
        pairs.append(("b", i % 3, x, rng.random(), [byte() for _ in range(size)], [byte() for _ in range(size)]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        sums = fr.layout_sums(spark.createDataFrame(pairs, "bus string, id int, x double, share double, before array<int>, after array<int>").coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    found = {}
    for r in sums:
        found.setdefault((r["bus"], r["id"], r["byte"], r["little"], r["shift"], r["bits"]), []).append(r)
    assert len(found) == 3 * 3 * len(fr.KINDS)
    if held == 500:
        # a row for each layout and length of frame, however many pairs there are
        assert len(sums) == 3 * (1 + 2 + 3) * len(fr.KINDS)
    for (_, id_, *layout), parts in found.items():
        own = [p for p in pairs if p[1] == id_ and len(p[4]) >= layout[0] + 2]
        at = [(p[2], p[3], value(p[4], *layout), value(p[5], *layout)) for p in own]
        fit = [(x, v0 + (v1 - v0) * s) for x, s, v0, v1 in at if x is not None and v0 is not None and v1 is not None]
        stand = [v0 for x, _, v0, _ in at if x is None and v0 is not None]
        assert sum(p["n"] for p in parts) == sum(x is not None for x, *_ in at)
        assert sum(p["fitted"] for p in parts) == len(fit) and sum(p["stood"] for p in parts) == len(stand)
        assert math.isclose(sum(p["fitted"] * p["my"] for p in parts), sum(y for _, y in fit), abs_tol=1e-6)
        assert math.isclose(sum(p["stood"] * p["stand"] for p in parts), sum(stand), abs_tol=1e-6)
        assert math.isclose(sum(p["sxy"] + p["fitted"] * p["mx"] * p["my"] for p in parts), sum(x * y for x, y in fit), rel_tol=1e-9, abs_tol=1e-6)
        assert math.isclose(sum(p["sxx"] + p["fitted"] * p["mx"] ** 2 for p in parts), sum(x * x for x, _ in fit), rel_tol=1e-9, abs_tol=1e-6)
        assert math.isclose(sum(p["syy"] + p["fitted"] * p["my"] ** 2 for p in parts), sum(y * y for _, y in fit), rel_tol=1e-9, abs_tol=1e-6)
