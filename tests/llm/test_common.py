import random

from pyspark.sql import functions as F

from panelrank.llm import common


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)]
    links += [(300 + r.randrange(60), 300 + r.randrange(60)) for _ in range(45)] + [(7, 7), (5, 4)]
    root = {x: x for pair in links for x in pair}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    found = {r.node: r.root for r in got}
    assert len(found) == len(got)
    assert all(found.get(x, x) == root[x] for x in root)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bounded_sample(spark):
    table = spark.range(5000).withColumn("v", F.lit("x"))
    some = common.bounded_sample(table, 300, "id")
    ids = [r.id for r in some.collect()]
    assert 200 < len(ids) <= 300
    assert ids == [r.id for r in common.bounded_sample(table.repartition(5), 300, "id").collect()]
    assert common.bounded_sample(table.limit(50), 300, "id").count() == 50


def test_texts_are_cut_into_chunks():
    texts = ["a" * 5, None, "b" * 20, "", "c" * 3, "d" * 3]
    assert list(common.chunks(texts, 10)) == [(0, 3), (3, 6)]
    assert list(common.chunks([], 10)) == [] and list(common.chunks([None], 10)) == [(0, 1)]


def test_memory_goes_back_when_a_task_ends_or_is_stopped(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    run = common.releasing(lambda batches: (2 * x for x in batches))
    assert list(run([1, 2, 3])) == [2, 4, 6] and len(given) == 1
    stopped = run([1, 2, 3])
    next(stopped)
    stopped.close()
    assert len(given) == 2


def test_freed_batches_leave_the_process():
    def held():
        with open("/proc/self/smaps_rollup") as lines:
            return sum(int(x.split()[1]) for x in lines if x.startswith("Pss_Anon:")) / 1024

    def run(batches):
        # Many small objects with one kept at the end: glibc holds on to what lies below it.
        room = [bytes(2000) for _ in range(40_000)]
        kept.append(bytes(2000))
        del room
        yield from batches

    kept, before = [], held()
    assert list(common.releasing(run)([])) == []
    assert held() - before < 30
