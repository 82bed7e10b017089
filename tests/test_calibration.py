"""The stream of calibration against its batch forms, with a restart."""

from __future__ import annotations

import random

import pytest

from weft.streaming import calibration as c

SCHEMA = "project string, " + c.EVENT


def plain(rows):
    held, bias, out = {}, {}, []
    for project, *event in rows:
        mine = held.setdefault(project, [])
        mine.append(tuple(event))
        del mine[:-500]
        chances = [(p, y) for _, p, y, _, _ in mine if p is not None]
        if event[4] is not None and len(mine) >= 3:
            last = [(a, b) for _, _, _, a, b in mine if b is not None][-20:]
            bias[project] = max(-0.15, min(0.15, sum(a - b for a, b in last) / len(last) / 100))
        out.append((project, event[0], len(mine), len(chances), sum((p - y) ** 2 for p, y in chances) / len(chances) if len(chances) >= 3 else None, bias.get(project, 0.0)))
    return out


def test_stream_equals_plain_figures_and_goes_on_after_a_restart(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"p{rnd.randint(0, 2)}", i, *((rnd.random(), float(rnd.randint(0, 1)), None, None) if rnd.random() < 0.5 else (None, None, float(rnd.randint(0, 40)), rnd.choice([None, float(rnd.randint(0, 40))])))) for i in range(1800)]
    for k, v in c.SETTINGS.items():
        spark.conf.set(k, v)
    source = str(tmp_path / "in")
    for part in (rows[:700], rows[700:]):  # the second run starts from the checkpoint of the first
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = c.calibrated(spark.readStream.schema(SCHEMA).parquet(source))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.project, r.ord): (r.n_events, r.n_chances, r.brier, r.bias) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {x[:2]: x[2:] for x in plain(rows)}
    assert got.keys() == want.keys() and max(x[0] for x in got.values()) == 500
    for key, (n, chances, brier, bias) in want.items():
        assert got[key][:2] == (n, chances) and got[key][2] == pytest.approx(brier) and got[key][3] == pytest.approx(bias)
