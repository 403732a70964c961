"""Split JSON values, the numbered log with several writers, the ordered checksum."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from siltstone.sources import frames, tables, writers
from siltstone.sources.log import Log
from siltstone.sources.registry import Registry


def odd_values(rng, n):
    texts = ['{"', '}]"\\', "\\\\", 'é\n"', "[[", "plain", "\\u00e9", ""]
    return [{"id": i, "t": rng.choice(texts) * rng.randint(0, 4), "l": [rng.randint(0, 9) for _ in range(rng.randint(0, 3))], "o": {"k": {"x": rng.choice(texts)}}} for i in range(n)]


def test_values_over_lines_and_splits(spark, tmp_path):
    rng = random.Random(5)
    for name in ("a", "b"):
        values = odd_values(rng, 400)
        text = "".join(json.dumps(v, indent=rng.choice([None, 1, 3]), ensure_ascii=rng.random() < 0.5) + rng.choice(["\n", "", " ", "\r\n\n"]) for v in values)
        (tmp_path / f"{name}.json").write_text(text + '{"id": 1, "t": "broken')
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        try:
            got = frames.json_frames(spark, str(tmp_path / f"{name}.json"))
            assert spark.read.text(str(tmp_path / f"{name}.json")).rdd.getNumPartitions() > 8
            assert [json.loads(r.text) for r in got.orderBy("at").collect()] == values
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    rows = tables.json_objects(spark, str(tmp_path), "id long, t string, l array<long>").collect()
    assert len(rows) == 800 and sum(r.id for r in rows) == 2 * sum(range(400))


def test_elements_of_an_inner_array(spark, tmp_path):
    docs = [{"relativePath": f"p{i}.py", "language": "python", "occurrences": [{"symbol": f"s{i}", "range": [i, 0, 3], "roles": 1}]} for i in range(50)]
    (tmp_path / "i.json").write_text(json.dumps({"metadata": {"tool": {"x": [1]}}, "documents": docs, "external": [{"symbol": "e"}]}, indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        got = tables.read_scip(spark, str(tmp_path / "i.json")).orderBy("doc_order").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.uri, r.symbol, r.start_line) for r in got] == [(f"p{i}.py", f"s{i}", i) for i in range(50)]


@pytest.mark.parametrize(("line", "at", "want"), [
    ('{"a":1}{"b":2} 3 [4]', 0, [('{"a":1}', True, True), ('{"b":2}', True, True), ("[4]", True, True)]),
    ('"}", 1}} {', 2, [('"}", 1}}', False, True), ("{", True, False)]),
    ("plain", 1, [("plain", False, False)]),
    ("plain", 0, []),
])
def test_pieces(line, at, want):
    assert frames.pieces(line, at, 0) == want


def test_long_strings_are_counted(spark, tmp_path):
    value = {"t": '\\"}{' * 200_000}
    (tmp_path / "l.json").write_text(json.dumps(value) + "\n{}\n")
    assert [json.loads(r.text) for r in frames.json_frames(spark, str(tmp_path / "l.json")).orderBy("at").collect()] == [value, {}]


def test_writers_at_the_same_time_take_each_number_once(spark, tmp_path):
    taken, errors = [], []

    def write(who):
        try:
            log = Log(spark, str(tmp_path / "log"))
            for i in range(8):
                taken.append(log.append(lambda known, i=i: {"who": who, "i": i, "seen": len(known)}))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    entries = Log(spark, str(tmp_path / "log")).entries()
    assert not errors and sorted(taken) == list(range(32))
    assert [e["seen"] for e in entries] == list(range(32))
    assert all([e["i"] for e in entries if e["who"] == w] == list(range(8)) for w in range(4))


def test_two_publishers(spark, tmp_path):
    versions = [writers.Versions(spark, str(tmp_path / "idx")) for _ in range(2)]
    df = spark.range(3)
    threads = [threading.Thread(target=lambda v=v, n=n: [v.publish(df, f"{n}-{k}") for k in range(3)]) for n, v in enumerate(versions)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = versions[0].log.entries()
    assert sorted(e["version"] for e in log) == [f"{n}-{k}" for n in range(2) for k in range(3)]
    assert versions[1].current() == log[-1]["version"] and versions[0].read().count() == 3


def test_of_two_that_begin_a_key_one_is_refused(spark, tmp_path):
    one, other = (Registry(spark, str(tmp_path / "runs")) for _ in range(2))
    put, first = Log._put, []

    def late(self, number, text):
        """The other writer comes between this one's look at the log and its entry."""
        if not first:
            first.append(1)
            other.record("run", "r", "begun", "/other")
        return put(self, number, text)

    Log._put = late
    try:
        with pytest.raises(ValueError):
            one.record("run", "r", "begun", "/one")
    finally:
        Log._put = put
    one.record("run", "r", "committed")
    assert [(r.key, r.root) for r in one.committed("run").collect()] == [("r", "/other")]


def test_checksum_tells_order_and_composes(spark):
    rows = [(i, f"h{i % 5}", -i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, h string, back long")
    a = writers.content_checksum(df.repartition(7), "id", "h").first()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    try:
        assert a == writers.content_checksum(df.repartition(3), "id", "h").first() and a.n == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a != writers.content_checksum(df, "id", "h", order=["back"]).first()
    moved = df.withColumn("back", F.when(F.col("id") == 3, -4).when(F.col("id") == 4, -3).otherwise(F.col("back")))
    assert writers.content_checksum(df, "id", "h", order=["back"]).first() != writers.content_checksum(moved, "id", "h", order=["back"]).first()
    assert tuple(writers.content_checksum(df.limit(0), "id", "h").first()) == (0, "0")


def test_refreshed_reads_the_last(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.refresh_if_changed(spark, spark.range(3), path, "x") and not writers.refresh_if_changed(spark, spark.range(4), path, "x")
    assert writers.refresh_if_changed(spark, spark.range(5), path, "y") and writers.refreshed(spark, path).count() == 5
