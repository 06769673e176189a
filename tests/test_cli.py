"""The command line on a small plot written as LAS."""

import json

import numpy as np
import pandas as pd
import pytest

from boscage import cli
from boscage.sources import las


@pytest.fixture(scope="module")
def plot(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("plot"), np.random.default_rng(5)
    gx, gy = (a.ravel() for a in np.meshgrid(np.arange(0, 10, 0.2), np.arange(0, 8, 0.2)))
    parts = [np.column_stack([gx, gy, 0.1 * gx + rng.normal(0, 0.005, len(gx))])]
    for cx, cy, d in ((3.0, 4.0, 0.40), (7.0, 4.0, 0.30)):
        th, h = rng.random(9000) * 2 * np.pi, rng.uniform(0.3, 2.9, 9000)
        r = d / 2 + rng.normal(0, 0.002, 9000)
        parts.append(np.column_stack([cx + r * np.cos(th), cy + r * np.sin(th), 0.1 * cx + h]))
    las.write(str(folder / "a.las"), np.vstack(parts))
    (folder / "t.json").write_text(json.dumps([{"tree_id": "A", "x": 3.05, "y": 4.0}, {"x": 7.0, "y": 4.05}]))
    (folder / "r.csv").write_text("tree_id,field_dbh_cm,measurement_method\nA,40,tape\ntree_002,30,caliper\nZ,20,tape\n")
    return folder


def read(folder, kind="json"):
    files = sorted(folder.glob("part-*"))
    return pd.concat([pd.read_json(f, lines=True) if kind == "json" else pd.read_csv(f) for f in files if f.stat().st_size])


def test_measure_and_benchmark(spark, plot):
    out = plot / "out"
    trees = ["--targets", f"file://{plot / 't.json'}", "--roi", "1.0", "--outdir", str(out)]
    assert cli.main(["measure", str(plot / "a.las"), *trees], spark) == 0
    got = read(out / "measurements.csv", "csv").set_index("tree_id")
    assert abs(got.dbh_cm["A"] - 40) < 1 and abs(got.dbh_cm["tree_002"] - 30) < 1 and len(got) == 2
    cli.main(["benchmark", str(plot / "a.las"), *trees, "-r", f"file://{plot / 'r.csv'}"], spark)
    s = read(out / "benchmark.json")
    s = s[s.stratum == "overall"].iloc[0]
    assert (s.n_matched, s.n_reported) == (2, 2) and s.max_abs_cm < 1
    assert read(out / "unmatched.json").tree_id.tolist() == ["Z"]


def test_detect_ground_and_inspect(spark, plot, capsys):
    cli.main(["detect", str(plot / "a.las"), "--decimate", "1", "-o", str(plot / "cand")], spark)
    c = read(plot / "cand")
    good = c[c.accepted]
    assert sorted(good.cx.round().tolist()) == [3, 7]
    cli.main(["inspect", str(plot / "a.las")])
    assert '"count": 20000' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["measure", str(plot / "a.las")], spark)
