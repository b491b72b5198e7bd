"""Connected components: results, and what a call costs the driver in rounds and tasks."""

import random
import uuid

import pytest

from tessera.llm import components as module
from tessera.llm import neardup
from tessera.llm.components import components
from tests.llm.helpers import odd_documents


def brute(links):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in list(root)}


def tasks(spark, run):
    """Tasks of all jobs that ``run`` starts, stages that were skipped not counted, and its result."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    known = [tracker.getStageInfo(s) for s in stages]
    return sum(x.numCompletedTasks for x in known if x), out


def test_stars_need_no_round(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a round over links that are settled")

    monkeypatch.setattr(module, "_round", never)
    links = [(9, 1), (1, 7), (8, 1), (20, 30), (30, 20), (40, 40), (None, 3), (7, 1)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == brute(links)
    assert len(got) == 6


@pytest.mark.parametrize("seed", range(3))
def test_equals_union_find(spark, seed):
    rng = random.Random(seed)
    nodes = rng.sample(range(-500, 500), 120)
    links = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(90)] + [(i, i + 1) for i in range(1000, 1040)] + [(None, 5), (3000, 2000)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == brute(links)
    assert len(got) == len({r["node"] for r in got})
    assert got == [] or set(got[0].asDict()) == {"node", "component"}


def test_ids_may_be_text(spark):
    links = [("c", "b"), ("b", "a"), ("z", "y")]
    got = components(spark.createDataFrame(links, "a string, b string")).collect()
    assert {r["node"]: r["component"] for r in got} == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}


def test_too_few_rounds_are_an_error(spark):
    with pytest.raises(RuntimeError, match="did not settle"):
        components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), max_rounds=1).count()


def test_tasks_of_near_duplicates_are_few_for_many_partitions(spark):
    """The driver keeps something of every task: with many shuffle partitions a call must not need thousands of them."""
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*words[: 50 + i % 8], *(f"x{i}" for _ in range(i % 3))]), "en", "a", 1) for i in range(40)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n, got = tasks(spark, lambda: neardup.near_duplicates(odd_documents(spark, rows)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 40
    assert n < 1400  # 1,600 when rounds were repeated to see that nothing moves
