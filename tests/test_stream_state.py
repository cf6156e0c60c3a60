"""Held rows of a stream: a timer reads passed spans only, one after the other; parts have as many files as the input has partitions."""

import glob
from types import SimpleNamespace

import pandas as pd

from webquarry.plans import stream_queries
from webquarry.streaming import jobs as S


class Map:
    def __init__(self):
        self.at, self.read = {}, []

    def containsKey(self, key):
        return key in self.at

    def getValue(self, key):
        self.read.append(key)
        return self.at[key]

    def updateValue(self, key, value):
        self.at[key] = value

    def removeKey(self, key):
        del self.at[key]

    def keys(self):
        return iter(list(self.at))


class Ordered(S._Ordered):
    held_schema = "us long, id long"
    block = 2

    def fold(self, key, rows):
        return rows.copy()


def test_timer_reads_passed_spans_only():
    maps, timers = {}, []
    handle = SimpleNamespace(getMapState=lambda name, *_: maps.setdefault(name, Map()), registerTimer=timers.append)
    job = Ordered()
    job.init(handle)
    times = [5 * job.span + 7, 3, 2, 1, job.span + 1, 5 * job.span + 8, job.span]
    list(job.handleInputRows(("k",), iter([pd.DataFrame({"us": times[:4], "id": range(4)}), pd.DataFrame({"us": times[4:], "id": range(4, 7)})]), None))
    mark = lambda us: SimpleNamespace(getCurrentWatermarkInMs=lambda: us // 1000)
    out = list(job.handleExpiredTimer(("k",), mark(2 * job.span), None))
    assert [x["us"].tolist() for x in out] == [[1, 2, 3], [job.span, job.span + 1]]
    assert {k[0] for k in maps["held"].read} == {0, 1} and {k[0] for k in maps["held"].at} == {5}
    out = list(job.handleExpiredTimer(("k",), mark(9 * job.span), None))
    assert [x["id"].tolist() for x in out] == [[0, 5]] and not maps["held"].at and not maps["blocks"].at


def test_parts_have_the_files_of_the_input(spark, sf_dir, monkeypatch):
    seen = []
    read = stream_queries.read
    monkeypatch.setattr(stream_queries, "read", lambda *a: read(*a).repartition(4))
    monkeypatch.setattr(S, "read_stream", lambda spark, path, rows, files_per_trigger: seen.append((path, files_per_trigger)))
    stream_queries.stream(spark, sf_dir)
    ((path, files),) = seen
    base = path.removeprefix("file:").removesuffix("/*")
    assert files == 4 and [len(glob.glob(f"{base}/{part}/*.parquet")) for part in range(7)] == [4, 4, 4, 4, 4, 4, 1]
