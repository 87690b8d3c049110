"""Rules of served replays and of drafts: each one is broken once."""

import copy

import pytest

from chronika.operators import replays

UNIT = dict(id="u", label="Line", faction="a", x=10.0, y=20.0, lat=0.0, lng=0.0)
MOVE = dict(faction="b", fromX=1.0, fromY=2.0, fromLat=0.0, fromLng=0.0, toX=0.0, toY=0.0, toLat=41.0, toLng=11.0)
PHASE = dict(index=0, title="T", narration="N", durationMs=6000, cameraLat=0.0, cameraLng=0.0, units=[UNIT, {**UNIT, "id": "v"}], movements=[MOVE])
GOOD = dict(id="r", title="R", intro="I", factionA="A", factionB="B", phases=[copy.deepcopy({**PHASE, "index": i}) for i in range(3)])


def put(path, value):
    r = copy.deepcopy(GOOD)
    at = r
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return r


U, M = ("phases", 1, "units", 1), ("phases", 2, "movements", 0)
DRAFTS = [
    (GOOD, []),
    (put(["title"], " "), [("title", "empty")]),
    (put(["intro"], None), [("intro", "empty")]),
    (put(["factionB"], ""), [("factionA,factionB", "both are required")]),
    (put(["phases"], GOOD["phases"][:2]), [("phases", "2 outside 3..12")]),
    (put(["phases"], [{**PHASE, "index": i} for i in range(13)]), [("phases", "13 outside 3..12")]),
    (put(["phases"], None), [("phases", "0 outside 3..12")]),
    (put(["phases", 1, "index"], 0), [("phases[1].index", "0 is not its position")]),
    (put(["phases", 1, "narration"], ""), [("phases[1].narration", "empty")]),
    (put(["phases", 0, "durationMs"], 4999), [("phases[0].durationMs", "4999 outside 5000..11000")]),
    (put(["phases", 0, "durationMs"], 11000), []),
    (put(["phases", 0, "units"], []), [("phases[0].units", "none")]),
    (put([*U, "faction"], "d"), [("phases[1].units[1].faction", '"d" is not a, b or c')]),
    (put([*U, "id"], "u"), [("phases[1].units[1].id", 'duplicate id "u"')]),
    (put([*U, "x"], 101.0), [("phases[1].units[1]", "x/y 101.0,20.0 outside 0..100")]),
    (put(U, {**UNIT, "id": "", "x": 50.0, "y": 50.0}), [("phases[1].units[1]", "x/y is the 50,50 placeholder")]),
    (put(U, {**UNIT, "id": "v", "x": 999.0, "lat": 95.0}), [("phases[1].units[1]", "lat/lng 95.0000,0.0000 out of range")]),
    (put(U, {**UNIT, "id": "v", "x": 999.0, "lat": 46.5, "lng": 10.0}), [("phases[1].units[1]", "lat/lng 46.5000,10.0000 more than 6 degrees from the event")]),
    (put(U, {**UNIT, "id": "v", "x": 999.0, "lat": 45.9, "lng": 10.0}), []),
    (put([*M, "toLng"], 19.0), [("phases[2].movements[0].to", "lat/lng 41.0000,19.0000 more than 6 degrees from the event")]),
    (put([*M, "fromX"], -1.0), [("phases[2].movements[0].from", "x/y -1.0,2.0 outside 0..100")]),
    (put([*M, "faction"], None), [("phases[2].movements[0].faction", '"" is not a, b or c')]),
    (put(["phases", 2, "cameraLat"], 1.0), [("phases[2].camera", "1.000,0.000 too far from the event")]),
    (put(["id"], ""), [("id", "empty")]),
    (put(["id"], "other"), [("id", "no event")]),
]
SERVED = [
    (GOOD, []),
    (put(["title"], ""), []),
    (put(["factionA"], ""), [("factionA,factionB", "both are required")]),
    (put(["phases"], GOOD["phases"][:1]), [("phases", "need at least 3 phases, got 1")]),
    (put(["phases"], [{**PHASE} for _ in range(13)]), []),
    (put(["phases", 1, "title"], None), [("phases[1].title", "required")]),
    (put([*U, "faction"], "x"), [("phases[1].units[1].faction", '"x" is not a, b or c')]),
    (put([*U, "y"], 100.5), [("phases[1].units[1]", "x,y 10.0,100.5 outside 0..100")]),
    (put([*M, "toY"], -0.5), [("phases[2].movements[0]", "coordinates outside 0..100")]),
]


@pytest.mark.parametrize("draft", [True, False])
def test_each_rule(spark, draft):
    events = spark.createDataFrame([("r", 40.0, 10.0), ("", 40.0, 10.0)], "id string, lat double, lng double")
    cases = DRAFTS if draft else SERVED
    # All cases in one frame, each with an id of its own but for those about ids.
    own = [r["id"] != "r" for r, _ in cases]
    rows = [r if o else {**r, "id": f"r{i:02d}"} for i, ((r, _), o) in enumerate(zip(cases, own))]
    events = events.unionByName(spark.createDataFrame([(f"r{i:02d}", 40.0, 10.0) for i in range(len(cases))], events.schema))
    frame = spark.createDataFrame(rows, replays.REPLAY)
    found = {}
    for x in (replays.validate_drafts(frame, events) if draft else replays.validate_served(frame)).collect():
        found.setdefault(x.id, []).append((x.path, x.message))
    assert found == {r["id"]: w for r, (_, w) in zip(rows, cases) if w}


def test_clean_drafts_are_accepted(spark):
    frame = spark.createDataFrame([GOOD, put(["title"], ""), put(["id"], "none")], replays.REPLAY)
    events = spark.createDataFrame([("r", 40.0, 10.0)], "id string, lat double, lng double")
    assert replays.accepted(frame.limit(0), events).count() == 0
    assert [r.id for r in replays.accepted(spark.createDataFrame([GOOD], replays.REPLAY), events).collect()] == ["r"]
    assert replays.accepted(frame, events).count() == 0
