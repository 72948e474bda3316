"""Shard sets: plans, commits, merges, damage."""

import pytest

from leafmill.llm import sharding
from leafmill.llm.common import shared_dir


def _shards(*sizes):
    return [{"path": str(i), "bytes": n, "seq": i} for i, n in enumerate(sizes)]


def test_plan_merges_like_sizes():
    mb = 1 << 20
    one = [s["path"] for s in sharding.plan(_shards(mb, mb, 60 * mb, mb, mb), 128 * mb)[0]]
    assert one == ["0", "1", "3", "4"]
    assert sharding.plan(_shards(mb, mb, mb), 128 * mb) == []  # too few for a tier, too small for the target
    assert sharding.plan(_shards(70 * mb, 70 * mb), 128 * mb) == []  # of half the target or more: full
    assert [len(g) for g in sharding.plan(_shards(*[40 * mb] * 7), 128 * mb)] == [3, 3]  # none above the target
    assert [len(g) for g in sharding.plan(_shards(33 * mb, 33 * mb), 128 * mb)] == [2]  # they fill half of it
    assert sharding.plan(_shards(200 * mb, 200 * mb), 128 * mb) == []  # full shards stay
    assert sharding.plan([]) == []


def test_tiers():
    assert [sharding.tier(n, 4, 1000) for n in (0, 999, 3999, 4000, 15_999, 16_000)] == [0, 0, 0, 1, 1, 2]


def test_appends_merge_and_stay_whole(spark):
    uri = shared_dir(spark, "shards-test")
    shards = sharding.ShardSet(spark, uri)
    for k in range(5):
        shards.append(spark.range(k * 100, k * 100 + 100).selectExpr("id", "if(id % 7 = 0, null, repeat('x', id % 50)) AS text").repartition(3))
    before = shards.manifest()
    assert before["version"] == 5 and len(before["shards"]) == 15
    rows = sorted(map(tuple, shards.read().collect()), key=repr)
    assert shards.compact(target=1 << 30) == 15
    after = shards.manifest()
    assert len(after["shards"]) == 1
    assert sorted(map(tuple, shards.read().collect()), key=repr) == rows
    assert sorted(map(tuple, shards.read(5).collect()), key=repr) == rows  # the older version is still there
    assert shards.vacuum() > 0
    assert sorted(map(tuple, shards.read().collect()), key=repr) == rows


def test_target_bounds_merges(spark):
    shards = sharding.ShardSet(spark, shared_dir(spark, "shards-test"))
    shards.append(spark.range(20_000).selectExpr("id", "uuid() AS text").repartition(8))
    sizes = [s["bytes"] for s in shards.manifest()["shards"]]
    shards.compact(target=max(sizes) * 2)
    made = shards.manifest()["shards"]
    assert 1 < len(made) < 8 and max(s["bytes"] for s in made) < 3.5 * max(sizes)
    assert shards.read().distinct().count() == 20_000


def test_second_writer_loses(spark):
    shards = sharding.ShardSet(spark, shared_dir(spark, "shards-test"))
    base = shards.append(spark.range(3).toDF("id"))
    shards.commit(base, base["shards"], base["next"])
    with pytest.raises(sharding.Conflict):
        shards.commit(base, [], 0)
    assert shards.append(spark.range(3).toDF("id"))["version"] == 3


def test_vacuum_spares_what_is_being_written(spark):
    """Append, vacuum and compact in between: files before their commit, young files, files of lost writers."""
    import os

    shards = sharding.ShardSet(spark, shared_dir(spark, "shards-test"))
    shards.append(spark.range(5).toDF("id"))
    written = shards.put(spark.range(5, 10).toDF("id").repartition(2))
    shards.vacuum()
    assert all(os.path.exists(f"{shards.path}/{s['path']}") for s in written)
    shards.arrive(written[:1], last=False)
    shards.vacuum()
    shards.arrive(written[1:])
    assert sorted(r["id"] for r in shards.read().collect()) == list(range(10))
    lost = shards.put(spark.range(100, 103).toDF("id"))
    os.utime(lost[0]["lease"], (1, 1))
    assert shards.vacuum(age=3600) == 0
    assert shards.vacuum() >= len(lost)
    assert shards.read().count() == 10


def test_compaction_goes_on_top_of_other_commits(spark, monkeypatch):
    """While shards are merged, others arrive, and another compaction takes some of the inputs."""
    shards = sharding.ShardSet(spark, shared_dir(spark, "shards-test"))
    for k in range(4):
        shards.append(spark.range(k * 10, k * 10 + 10).toDF("id").repartition(2))
    merge = sharding.ShardSet._merged
    todo = ["arrive", "compact"]

    def late(self, groups, name):
        made = merge(self, groups, name)
        if todo:
            if todo.pop(0) == "arrive":
                self.append(spark.range(40, 50).toDF("id").coalesce(1))
            else:
                self.compact(1 << 30)
        return made

    monkeypatch.setattr(sharding.ShardSet, "_merged", late)
    assert shards.compact(1 << 30) == 8
    for k in range(3):
        shards.append(spark.range(50 + k * 10, 60 + k * 10).toDF("id").coalesce(1))
    shards.compact(1 << 30)
    shards.vacuum()
    assert sorted(r["id"] for r in shards.read().collect()) == list(range(80))
    assert len(shards.manifest()["shards"]) == 1  # the inner compaction had all five; the outer one's merge was for nothing


def test_lists_stay_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LIST", 3)
    shards = sharding.ShardSet(spark, shared_dir(spark, "shards-test"))
    new = lambda n, k: [{"path": f"data/{k}-{i}", "bytes": 1, "seq": i} for i in range(n)]
    base = shards.commit(shards.manifest(), new(7, "a"), 7)
    assert [len(x) for x in base["lists"].values()] == [3, 3, 1]
    after = shards.commit(base, [s for s in base["shards"] if s["path"] != "data/a-4"] + new(1, "b"), 8)
    assert set(base["lists"]) & set(after["lists"]) == {list(base["lists"])[0], list(base["lists"])[2]}
    assert sorted(s["path"] for s in after["shards"]) == sorted([f"data/a-{i}" for i in (0, 1, 2, 3, 5, 6)] + ["data/b-0"])
