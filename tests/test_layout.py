"""Planted on/off structure and what the layout makes of it; a plain sequential model to compare with."""

import random

import pytest

from latticeflow.operators import layout


def frame(spark, tracks):
    rows = [(k, i, float(on), float(full)) for k, bars in tracks.items() for i, (on, full) in enumerate(bars)]
    return spark.createDataFrame(rows, "track string, bar long, kick double, full double")


def bars(n, spans, first=0.5, kick=0.5, audible=None):
    """n bars: kick 1 in the spans, else ``kick`` from bar ``first`` on."""
    out = []
    for i in range(n):
        on = any(a <= i < b for a, b in spans)
        out.append((1.0 if on else 0.3 if i >= 0 else 0.0, 1.0 if audible is None or i < audible else 0.0))
    return out


def run(spark, tracks, locked=None, rules=layout.RULES):
    return {r["track"]: r for r in layout.layout(frame(spark, tracks), ["track"], locked, rules).collect()}


def test_full_layout(spark):
    t = run(spark, {"t": bars(96, [(32, 64), (80, 92)])})["t"]
    assert [t[x] for x in "abcdef"] == [0, 0, 24, 32, 64, 80]
    assert t["g"] == 92 and t["h"] is None
    assert "D: raw bar 32, off8=+0, off16=+0, off32=+0, at bar 32" in t["notes"]


def test_snap_and_off_phrase(spark):
    out = run(spark, {"near": bars(96, [(33, 64)]), "far": bars(96, [(37, 64)])})
    assert out["near"]["d"] == 32 and out["far"]["d"] == 37
    assert any("off-phrase (unsnapped)" in n for n in out["far"]["notes"])


def test_dips_and_short_tracks(spark):
    out = run(spark, {"dip": bars(96, [(32, 50), (51, 92)]), "short_dip": bars(96, [(32, 50), (54, 70), (78, 90)]), "short": bars(12, [(4, 12)]), "silent": [(0.0, 0.0)] * 40})
    assert out["dip"]["e"] is None
    assert out["short_dip"]["e"] == 70 or out["short_dip"]["e"] == 72
    assert out["short"]["d"] is None and "track too short for bass structure analysis; first beat only" in out["short"]["notes"]
    assert out["silent"]["a"] == 0 and "no kick-band energy detected; first beat only" in out["silent"]["notes"]


def test_unlocked_is_not_snapped(spark):
    from pyspark.sql import functions as F

    t = run(spark, {"t": bars(96, [(33, 64)])}, F.lit(False))["t"]
    assert t["d"] == 33


def model(rows, r):
    """The layout of one track by plain loops, locked."""
    import numpy as np

    kick, full = [x[0] for x in rows], [x[1] for x in rows]
    n = len(rows)
    loud, ref = float(np.percentile(kick, 90)), float(np.percentile(full, 95))
    on, state = [], False
    for x in kick:
        state = (x >= r.on * loud) if not state else not (x < r.off * loud)
        on.append(state and loud > 0)
    audible = [ref <= 0 or x >= r.audible * ref for x in full]
    a = next((i for i, x in enumerate(kick) if x >= 0.25 * loud and (i + 1 == n or x >= 0.75 * kick[i + 1])), 0)
    if loud <= 0 or n < r.min_bars:
        return {"a": a}
    spans, i = [], 0
    while i < n:
        j = i
        while j < n and on[j] == on[i]:
            j += 1
        spans.append((i, j - i, on[i]))
        i = j
    near = lambda b: a + round((b - a) / 8) * 8
    snap = lambda b: near(b) if abs(b - near(b)) <= 2 else b
    d, off, seen, before = None, 0, 0, None
    for s, k, o in spans:
        if o:
            if d is None and k >= r.drop_on and off >= r.drop_off and (seen or s >= r.drop_share * n):
                d, before = s, s - off if off else None
            seen += 1
        else:
            off = k
    e = next((s for s, k, o in spans if d is not None and not o and s > d and k >= r.break_off), None)
    f = next((s for s, k, o in spans if e is not None and o and s > e and k >= r.return_on), None)
    if d is not None and (d == a or snap(d) <= a):
        d = e = f = None
    out = {"a": a, "d": None if d is None else snap(d), "e": None if e is None else snap(e), "f": None if f is None else snap(f)}
    c = None
    if d is not None:
        if before is not None and before > a:
            c = next((x for x in (snap(before), before) if a < x < out["d"]), None)
        else:
            inner = [a + 8 * k for k in range(1, n) if a < a + 8 * k < out["d"]]
            c = inner[-1] if inner else None
    out["c"] = c
    last = max((i for i, x in enumerate(audible) if x), default=n - 1)
    top = max(x for x in (a, c, out["d"], out["e"], out["f"]) if x is not None)
    trailing = spans[-1][0] if not spans[-1][2] and spans[-1][1] >= 2 else None
    most, g, tail = last - 16, None, True
    if most >= 0:
        if trailing is not None and top < trailing <= most:
            g = trailing
        else:
            grid = [a + 8 * k for k in range(n) if top < a + 8 * k <= most]
            g = grid[-1] if grid else None
    if g is None:
        tail = False
        late = n - 2
        grid = [a + 8 * k for k in range(n) if a + 8 * k <= late] if late > a else []
        g = next((x for x in (trailing, grid[-1] if grid else None) if x is not None and top < x <= last), None)
    if g is not None:
        ok = lambda x: top < x <= last and (not tail or last - x >= 16)
        g = next((x for x in (snap(g), g) if ok(x)), None)
    out["g"] = g
    loop = lambda b: b + 8 <= n and all(audible[b : b + 8])
    h = None
    if g is not None:
        grid = [a + 8 * k for k in range(n) if a + 8 * k <= last - 7 and loop(a + 8 * k)]
        h = grid[-1] if grid else None
        if h is not None and h < g:
            h = g if loop(g) else None
    out["h"] = h
    return in_order({**out, "b": a})


def in_order(slots):
    """Slots without those out of order, one at a time from the start."""
    for i, x in enumerate("abcdefgh"):
        held = [slots[y] for y in "abcdefgh"[:i] if slots[y] is not None]
        nxt = slots["abcdefgh"[i + 1]] if x in "cde" else None
        if slots[x] is not None and ((held and slots[x] < held[-1]) or (nxt is not None and slots[x] >= nxt)):
            return in_order({**slots, x: None, **({"h": None} if x == "g" else {})})
    return slots


@pytest.mark.parametrize("rules", [layout.RULES, layout.RELAXED])
def test_against_model(spark, rules):
    rng = random.Random(5)
    tracks = {}
    for k in range(60):
        n, level, rows = rng.randint(10, 140), 0.2, []
        for _ in range(n):
            if rng.random() < 0.12:
                level = rng.choice([0.1, 0.3, 0.9, 1.0])
            rows.append((round(level * rng.uniform(0.8, 1.0), 3), rng.choice([1.0, 1.0, 1.0, 0.01]) if rng.random() < 0.2 else 1.0))
        tracks[f"t{k}"] = rows
    out = run(spark, tracks, rules=rules)
    for k, rows in tracks.items():
        want = model(rows, rules)
        assert {x: out[k][x] for x in want} == want, k
        assert all(out[k][x] is None for x in "cdefgh" if x not in want)


def test_monotonic(spark):
    from pyspark.sql import functions as F

    cases = [([1, 1, 5, 4, 8, 9, 10, 10], [1, 1, None, 4, 8, 9, 10, 10]), ([0, 0, 1, 2, 3, 4, 3.5, 5], [0, 0, 1, 2, 3, 4, None, None]), ([0, None, None, 5, 5, 6, 7, 8], [0, None, None, None, 5, 6, 7, 8]), ([None] * 8, [None] * 8)]
    df = spark.createDataFrame([(i, [None if x is None else float(x) for x in c]) for i, (c, _) in enumerate(cases)], "i int, s array<double>")
    got = {r[0]: r[1] for r in df.select("i", layout.monotonic(F.col("s"))["slots"]).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == [None if x is None else float(x) for x in want]
    notes = {r[0]: r[1] for r in df.select("i", layout.monotonic(F.col("s"))["notes"]).collect()}
    assert notes[0] == ["C: omitted (5.00s >= D 4.00s; monotonicity)"] and notes[3] == []
    assert notes[1] == ["G: omitted (3.50s < previous 4.00s; monotonicity)", "H: omitted (G omitted)"]


def test_order_is_checked_after_snapping(spark):
    """A drop and a break that snap to one bar: the drop goes, with a note."""
    rows = [(1.0 if on else 0.1, 1.0) for on in ([1] * 8 + [0] * 7 + [1] * 2 + [0] * 15 + [1] * 8)]
    t = run(spark, {"t": rows}, rules=layout.RELAXED)["t"]
    raw = layout.raw_events(layout.states(frame(spark, {"t": rows}), ["track"], layout.RELAXED), ["track"], layout.RELAXED).first()
    assert (raw["d"], raw["e"]) == (15, 17) and t["a"] == 0
    assert t["d"] is None and t["e"] == 16 and "D: omitted (16.00s >= E 16.00s; monotonicity)" in t["notes"]


def test_times_and_lock_by_rows(spark):
    from pyspark.sql import functions as F

    df = frame(spark, {"on": bars(96, [(33, 64)]), "off": bars(96, [(33, 64)])}).withColumn("start", F.col("bar") * 2.0 + 0.5).withColumn("ok", F.col("track") == "on")
    out = {r["track"]: r for r in layout.layout(df, ["track"], F.col("ok")).collect()}
    assert out["on"]["d"] == 32 and out["off"]["d"] == 33 and out["on"]["starts"][32] == 64.5
    assert not any(n.startswith("D: raw") for n in out["off"]["notes"])
