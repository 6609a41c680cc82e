"""What a near-dedup run asks of the driver: few edges are one job and not a round after another."""

import random

from tidemark.llm import simhash


def test_few_edges_are_contracted_in_one_step(spark, monkeypatch):
    rng = random.Random(5)
    names = rng.sample(range(-(2**40), 2**40), 700)
    chains = [names[:300], names[300:600], *([a, b] for a, b in zip(names[600:650], names[650:]))]
    edges = sorted({(min(a, b), max(a, b)) for c in chains for a, b in zip(c, c[1:])} | {(min(names[0], x), max(names[0], x)) for x in names[1:90]})
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    cuts, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda d, name: cuts.append(name) or cut(d, name))
    want = {x: min(c) for c in chains for x in c}
    for most, steps in ((1_000_000, 1), (250, None), (0, None)):
        cuts.clear()
        assert {r["u"]: r["root"] for r in simhash.components(df, at_once=most).collect()} == want
        assert len(cuts) == steps if steps else len(cuts) > 2
    assert simhash.components(df.limit(0)).count() == 0
