from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codeloom.operators import tasks

NOW = datetime(2024, 5, 8, 12)
SHAPE = "id string, status string, priority int, due timestamp, assignee string, tags array<string>, ordinal int"


def test_schedule(spark):
    day = timedelta(days=1)
    rows = [
        ("done", "done", 1, None, None, [], 0), ("busy", "in_progress", 4, None, "ann", [], 1), ("other", "in_progress", 3, None, "zed", [], 2),
        ("late", "pending", 1, NOW - 3 * day, None, [], 3), ("high", "pending", 3, None, None, ["skill:ann"], 4), ("soon", "pending", 3, NOW + day, "bob", [], 5),
        ("waits", "pending", 4, None, None, [], 6), ("freed", "blocked", 4, None, None, [], 7), ("low", "pending", 1, None, None, None, 8),
    ]
    links = spark.createDataFrame([("waits", "low"), ("freed", "done"), ("freed", "gone")], "task string, needs string")
    made = spark.createDataFrame(rows, SHAPE)
    # ann starts at 4: "freed" goes to bob (4), "soon" is bob's (7), "high" is ann's by skill (7), nobody has room after
    assert tasks.schedule(made, links, ["ann", "bob"], F.lit(NOW)) == [("freed", "bob"), ("soon", "bob"), ("high", "ann")]
    # cat takes 4; soon goes to the idle dan (3); then cat 4, dan 3: high to dan (6); late is raised to 3: cat (7); low has no room
    assert tasks.schedule(made, links, ["cat", "dan"], F.lit(NOW)) == [("freed", "cat"), ("soon", "dan"), ("high", "dan"), ("late", "cat")]
    assert tasks.schedule(made, links, [], F.lit(NOW)) == [] == tasks.schedule(made.limit(0), links, ["ann"], F.lit(NOW))


def test_business_days_against_a_walk(spark):
    starts = [datetime(2024, 5, 1, 9) + timedelta(days=i) for i in range(8)]
    rows = [(s, s + timedelta(days=d, hours=h)) for s in starts for d in (-2, 0, 1, 5, 6, 7, 13, 30) for h in (0, 5)]
    got = spark.createDataFrame(rows, "a timestamp, b timestamp").select("a", "b", tasks.business_days("a", "b").alias("n"), tasks.next_business_day("a").alias("d"), tasks.is_weekend("a").alias("w")).collect()
    for r in got:
        at, n = r.a + timedelta(days=1), 0
        while at <= r.b:
            n, at = n + (at.weekday() < 5), at + timedelta(days=1)
        after = next(r.a + timedelta(days=k) for k in (1, 2, 3) if (r.a + timedelta(days=k)).weekday() < 5)
        assert (r.n, r.d, r.w) == (n, after, r.a.weekday() >= 5)


def test_links_that_go_round(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "a"), ("d", None)], "task string, needs string")
    assert {(r.id, r.depth) for r in tasks.dependencies(links, "a").collect()} == {("b", 1), ("c", 2), ("a", 3), ("d", 3)}
    assert tasks.makes_cycle(links, "d", "a") and not tasks.makes_cycle(links, "a", "d") and not tasks.makes_cycle(links.limit(0), "x", "y")


def test_json_store(spark, tmp_path):
    store = tasks.JsonStore(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(list(r), "id string, record string")
    assert store.load("t", "a") is None and store.count("t") == 0 and not store.delete("t", "a")
    store.save("t", rows(("a", '{"x":1}'), ("b", "{}")))
    store.save("t", rows(("a", '{"x":2}')))
    assert store.load("t", "a") == '{"x":2}' and store.count("t") == 2
    assert store.delete("t", "b") and not store.delete("t", "b") and [r.id for r in store.all("t").collect()] == ["a"]
    store.clear("t")
    assert store.count("t") == 0
