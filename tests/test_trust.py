"""Trust in fixes through a drive with a jump, a standing spoof, a gap and a wrong reckoning."""

import math

from tidemark.operators import stateful, trust
from tidemark.streaming import windows

COLS = ["id", "t", "x", "y", "sigma", "acc", "driven", "unknown", "tx", "ty", "epoch", "inside", "distances", "sigmas"]
SCHEMA = "trip long, id long, t long, x double, y double, sigma double, acc double, driven double, unknown double, tx double, ty double, epoch long, inside boolean, distances array<double>, sigmas array<double>"


def drive():
    """(row, what it is): ten metres a second along x; ids are seconds."""
    rows = []

    def add(s, x=None, off=0.0, sure=5.0, inside=True, reckoned=True):
        x = 10.0 * s if x is None else x
        rows.append((1, s, s * 1_000_000, x, 0.0, 3.0, 6.0, 10.0 * s, 0.0, 10.0 * s, 0.0, 1, inside, [off] if reckoned else None, [sure] if reckoned else None))

    for s in range(20):
        add(s)
    for s in range(20, 40):
        add(s, x=9000.0, off=8000.0)  # jumps away and stands there
    for s in range(40, 48):
        add(s)  # the real ones are back, where the vehicle is reckoned
    for s in range(90, 96):
        add(s, off=700.0)  # after a gap, far from a reckoning
    for s in range(96, 120):
        add(s, off=700.0)  # but they move as the vehicle does
    add(120, inside=False)
    return rows


def verdicts(rows):
    step, state, out = trust.trust(), trust.TRUST_START, []
    for r in rows:
        state, got = step(state, r[1:])
        out += got
    return {n: (v, verified, shown) for n, v, verified, shown in out}


def test_a_drive():
    got = verdicts(drive())
    assert all(got[s] == ("ok", False, "trusted") for s in range(20))
    assert got[20][0] == "jump" and {got[s][0] for s in range(21, 40)} <= {"jump", "untrusted", "shape"} and got[30][2] == "untrusted"
    # five fixes in a row over four seconds, on the reckoning
    assert [got[s][0] for s in range(40, 46)] == ["reacquiring"] * 4 + ["ok", "ok"] and got[41][2] == "reacquiring" and got[44][2] == "trusted"
    assert [got[s][0] for s in range(90, 100)] == ["far"] * 10
    first = next(s for s in range(90, 120) if got[s][0] == "ok")
    assert got[first][1] and first == 110 and got[119] == ("ok", False, "trusted")
    assert got[120][0] == "outside"


def test_a_stream_that_stands_while_the_vehicle_drives():
    rows = [(1, s, s * 1_000_000, 0.0 if s < 30 else 10.0 * s, 0.0, 3.0, 6.0, 10.0 * s, 0.0, 10.0 * s, 0.0, 1, True, None, None) for s in range(40)]
    got = verdicts(rows)
    assert [got[s][0] for s in range(5)] == ["ok"] * 5
    failed = next(s for s in range(30) if got[s][0] == "shape")
    # five metres a step are within the slack up to 5 * 10 m; the first test fails
    assert failed == 5 and got[failed][2] == "untrusted" and got[29][0] in ("shape", "untrusted")
    # a fix that comes late joins the segment of its time
    late = (1, 99, 7_500_000, 75.0, 0.0, 3.0, 6.0, 75.0, 0.0, 75.0, 0.0, 1, True, [1.0], [5.0])
    ordered = [r for r in drive() if r[1] < 10]
    assert verdicts([*ordered, late])[99][0] == "ok"


def test_batch_and_stream_agree(spark, tmp_path):
    rows = drive()
    df = spark.createDataFrame(rows, SCHEMA)
    out = f"trip long, id long, {trust.TRUSTED}"
    got = stateful.batch(df.repartition(4), "trip", COLS, trust.trust(), trust.TRUST_START, out, ["t", "id"]).orderBy("id").collect()
    assert {r["id"]: (r["verdict"], r["verified"], r["shown"]) for r in got} == verdicts(rows)
    for k in range(3):
        df.filter(f"id >= {40 * k} and id < {40 * k + 40 + (k == 2)}").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    windows.run_available(stateful.stream(src, "trip", COLS, trust.trust(), trust.TRUST_START, out, trust.TRUST_STATE, ["t", "id"]), str(tmp_path))
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("id").collect()] == [tuple(r) for r in got]
    assert math.isclose(trust.reach(trust.Limits(), {"t": 0, "sigma": 3.0, "driven": 0.0, "unknown": 0.0}, {"t": 10_000_000, "sigma": 4.0, "driven": 100.0, "unknown": 1.0}), 105 + 55 + 30 + 15 + 20)
