"""Custom datasets as batch and stream sources, and controllers with state: restarts lose and double nothing."""

import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from weftline.sources import custom
from weftline.streaming import control

FAILING = """
import os
from weftline.sources.custom import JsonLines

class Failing(JsonLines):
    def rows(self, start, stop):
        for i, row in enumerate(super().rows(start, stop)):
            if start + i == 25 and os.path.exists(self.path + ".fail"):
                raise RuntimeError("lost here")
            yield row

class Small:
    def __init__(self, options):
        self.n = int(options.get("n", 3))
    def schema(self):
        return "i long"
    def count(self):
        return self.n
    def rows(self, start, stop):
        return ((i,) for i in range(start, stop))

def longest(df, least):
    return df.where(df.v >= least).selectExpr("-k as k")

def other(df):
    return df.selectExpr("k as z")
"""


@pytest.fixture
def module(tmp_path):
    (tmp_path / "own.py").write_text(FAILING)
    return str(tmp_path / "own.py")


def lines(path, ids):
    with open(path, "a") as f:
        f.writelines(json.dumps({"id": i, "v": f"t{i}"}) + "\n" for i in ids)


def taken(spark, stream, out):
    q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(r.id for r in spark.read.schema("id long").parquet(f"{out}/data").collect())


def test_a_stream_goes_on_where_it_ended(spark, tmp_path, module):
    path, out = str(tmp_path / "rows.jsonl"), str(tmp_path / "out")
    lines(path, range(20))
    stream = lambda: custom.stream_dataset(spark, f"{module}:Failing", path=path, schema="id long, v string", rowsPerTask=7)
    assert taken(spark, stream(), out) == list(range(20))
    assert taken(spark, stream(), out) == list(range(20))  # nothing new
    lines(path, range(20, 40))
    (tmp_path / "rows.jsonl.fail").write_text("")
    with pytest.raises(Exception, match="lost here"):
        taken(spark, stream(), out)
    lines(path, range(40, 45))
    with open(path, "a") as f:
        f.write('{"id": 45')  # not complete yet
    (tmp_path / "rows.jsonl.fail").unlink()
    taken(spark, stream(), out)
    assert taken(spark, stream(), out) == list(range(45))
    with open(path, "a") as f:
        f.write(', "v": "t45"}\n')
    assert taken(spark, stream(), out) == list(range(46))


def test_batches_are_read_in_ranges(spark, tmp_path, module):
    for n, step, tasks in ((0, 5, 1), (1, 5, 1), (23, 5, 5), (10, 5, 2)):
        df = custom.read_dataset(spark, f"{module}:Small", n=n, rowsPerTask=step)
        assert sorted(r.i for r in df.collect()) == list(range(n)) and df.rdd.getNumPartitions() == tasks
    path = str(tmp_path / "odd.jsonl")
    with open(path, "w") as f:
        f.write('{"id": 1}\nnot json\n[1]\n{"v": null, "id": 2, "more": 3}\n')
    got = custom.read_dataset(spark, "weftline.sources.custom:JsonLines", path=path, schema="id long, v string").collect()
    assert sorted(((r.id, r.v) for r in got), key=repr) == [(1, None), (2, None), (None, None), (None, None)]
    with pytest.raises(Exception, match="rowsPerTask"):
        custom.read_dataset(spark, f"{module}:Small", rowsPerTask=0).count()


def test_rows_of_parquet_by_number(spark, tmp_path):
    (tmp_path / "t").mkdir()
    ids = list(range(101))
    for k, part in enumerate((ids[:40], ids[40:41], ids[41:])):
        pq.write_table(pa.table({"id": part, "w": [str(i) for i in part], "l": [[i] for i in part]}), tmp_path / "t" / f"{k}.parquet", row_group_size=13)
    rows = custom.ParquetRows({"path": str(tmp_path / "t"), "columns": "id"})
    rng = random.Random(1)
    for start, stop in [(0, 101), (0, 0), (100, 101)] + [tuple(sorted(rng.choices(range(102), k=2))) for _ in range(40)]:
        assert [i for b in rows.rows(start, stop) for i in b.column("id").to_pylist()] == ids[start:stop]
    df = custom.read_dataset(spark, "weftline.sources.custom:ParquetRows", path=str(tmp_path / "t"), rowsPerTask=30)
    assert sorted(tuple(r) for r in df.collect()) == [(i, str(i), [i]) for i in ids]


def test_loading_and_generators(spark, module):
    for wrong, error in (("nothing", ValueError), (f"{module}:missing", AttributeError), ("/nowhere/x.py:A", FileNotFoundError), ("no.such.module:A", ModuleNotFoundError)):
        with pytest.raises(error):
            custom.load(wrong)
    df = spark.createDataFrame([(1, 5), (2, 9)], "k long, v long")
    assert sorted((tuple(r) for r in custom.with_generated(df, f"{module}:longest", least=6).collect()), key=repr) == [(-2, None), (1, 5), (2, 9)]
    with pytest.raises(ValueError, match="z"):
        custom.with_generated(df, f"{module}:other")


def loop(rows, start, target, horizon):
    value, out = {}, {}
    for run, step, divergence, n in sorted(rows):
        out[run, step] = value.setdefault(run, start)
        value[run] *= 1 + min(max(divergence / target - 1, -0.2), 0.2) * n / horizon
    return out


def test_the_controller_is_a_loop_over_batches_also_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(run, step, rng.uniform(0, 0.3), rng.randint(1, 400)) for run in ("a", "b") for step in range(30)]
    kind = "run string, step long, divergence double, n long"
    want = loop(rows, 0.2, 0.1, 10_000)

    def feed(part):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        held = control.adaptive_coefficients(stream, 0.2, 0.1, 10_000)
        q = held.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        return {(a, s): c for a, s, c in got}, len(got)

    feed([r for r in rows if r[1] < 7])
    feed([r for r in rows if 7 <= r[1] < 12])
    got, n = run()
    assert n == 24 and all(got[k] == pytest.approx(want[k]) for k in got)
    feed([r for r in rows if 5 <= r[1] < 20])  # five to eleven come again
    feed([(*rows[0][:1], None, 1.0, 5), ("a", 90, None, 5)])
    feed([r for r in rows if r[1] >= 20])
    got, n = run()
    assert n == 60 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    table = control.coefficients_of(spark.createDataFrame(rows, kind), 0.2, 0.1, 10_000)
    assert all(r.coefficient == pytest.approx(want[r.run, r.step]) for r in table.collect())
    with pytest.raises(Exception, match="horizon"):
        control.coefficients_of(spark.createDataFrame([("a", 1, 0.0, 90), ("a", 2, 0.0, 90)], kind), 0.2, 0.1, 1).collect()
