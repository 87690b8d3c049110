"""Registries that follow a folder: generations of whole files."""

import os

from chronika.streaming.registry import FollowedRegistry


def test_generations(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    registry = FollowedRegistry(spark, str(tmp_path / "table"), "struct<start:int>")
    run = lambda: registry.follow(str(folder), str(tmp_path / "check")).awaitTermination()

    def put(name, text, at):
        (folder / name).write_text(text)
        os.utime(folder / name, (1_700_000_000 + at, 1_700_000_000 + at))

    def stands():
        return registry.generation(), {r.key: r.value.start for r in registry.rows().collect()}

    run()
    assert stands() == (0, {})
    put("a.json", '{"A": {"start": 1}}', 100)
    run()
    assert stands() == (1, {"A": 1})
    put("b.json", "{broken", 200)
    put("c.json", "[1, 2]", 210)
    put("c2.json", '{"B": {"start": 2}}}{', 220)
    put("c3.json", '{"B": {"start": 2}},{"C": {"start": 2}}', 230)
    put("c4.json", "", 240)
    run()
    assert stands() == (1, {"A": 1})
    put("late.json", '{"L": {"start": 9}}', 50)
    run()
    assert stands() == (1, {"A": 1})
    # Of two good files in one batch the newer one; of one time the later path.
    put("d.json", '{"D": {"start": 4}}', 300)
    put("e.json", '{"E": {"start": 5}, "F": {"start": 6}}', 300)
    put("f.json", '{"G": {"start": 7}}', 290)
    run()
    assert stands() == (2, {"E": 5, "F": 6})
    put("g.json", "{}", 400)
    run()
    assert stands() == (3, {})
    assert {r.key for r in registry.rows(1).collect()} == {"A"}
    assert [(r.generation, r.n) for r in registry.manifest().orderBy("generation").collect()] == [(1, 1), (2, 2), (3, 0)]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    registry = FollowedRegistry(spark, str(tmp_path / "table"), "struct<start:int>")
    files = spark.sql("select '{\"A\": {\"start\": 1}}' as value, 'a' as path, timestamp'2024-01-01 00:00:00' as modified")
    newer = spark.sql("select '{\"B\": {\"start\": 2}}' as value, 'b' as path, timestamp'2024-01-02 00:00:00' as modified")
    assert registry.load(files, 0) == 1 and registry.load(files, 0) is None
    assert registry.load(newer, 0) is None and registry.generation() == 1
    # An attempt that wrote rows but no line in the manifest is written over.
    registry.spark.createDataFrame([("X", (9,))], "key string, value struct<start:int>").write.parquet(f"{registry.path}/rows/generation=2")
    assert {r.key for r in registry.rows().collect()} == {"A"}
    assert registry.load(newer, 1) == 2 and {r.key for r in registry.rows().collect()} == {"B"}
