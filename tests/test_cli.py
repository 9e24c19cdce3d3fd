"""End-to-end through the command line on a small raw CSV fixture."""

import gzip
import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(*args, timeout=300):
    env = dict(os.environ, PYTHONPATH=ROOT)
    out = subprocess.run([sys.executable, "-m", "haze", "--master", "local[2]",
                          "--shuffle-partitions", "4", *args],
                         capture_output=True, text=True, env=env, timeout=timeout, cwd=ROOT)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout


def test_cli_pipeline(tmp_dir):
    raw = os.path.join(tmp_dir, "raw", "month=2025-01")
    os.makedirs(raw)
    lines = ["location_id,datetime,parameter,value,lat,lon"]
    for i in range(0, 120, 20):
        t = f"2025-01-01T10:0{i // 60}:{i % 60:02d}+07:00"
        lines += [f"1,{t},pm2.5,{10 + i},21,105", f"1,{t}, PM10 ,{30 + i},21,105"]
    with gzip.open(os.path.join(raw, "location-1.csv.gz"), "wt") as fh:
        fh.write("\n".join(lines) + "\n")
    wide, dense, msgs = (os.path.join(tmp_dir, p) for p in ("wide", "dense", "msgs"))
    _run("etl", os.path.join(tmp_dir, "raw", "month=*", "location-*.csv.gz"), wide)
    _run("densify", wide, dense, "--step", "5", "--noise", "0",
         "--off-grid", "drop")
    _run("publish", dense, "--out-dir", msgs)
    hist = os.path.join(tmp_dir, "hist")
    _run("stream", "--source", "text", "--path", msgs, "--mode", "dual", "--once",
         "--checkpoint", os.path.join(tmp_dir, "ck"), "--history", hist,
         "--snapshot", os.path.join(tmp_dir, "snap"))
    report = json.loads(_run("freshness", hist, "--as-of", "2025-01-01 03:02:00").strip()
                        .splitlines()[-1])
    # 21 grid rows (100 s at 5 s), newest 03:01:40 UTC -> 20 s old
    assert report["count"] == 21 and report["age_s"] == 20.0 and report["status"] == "OK"
    lag = json.loads(_run("lag", hist, "--messages", msgs).strip().splitlines()[-1])
    assert lag == {"produced": 21, "stored": 21, "lag": 0}
    out = _run("analyze", hist, "--as-of", "2025-01-01 03:02:00", "--window", "60",
               "--output", os.path.join(tmp_dir, "lat"))
    report = json.loads(out.strip().splitlines()[-1])
    assert report["raw"] == 21 and report["valid"] + report["invalid"] + report["old"] == 21
    _run("compact", hist, os.path.join(tmp_dir, "compacted"))
    assert os.path.isdir(os.path.join(tmp_dir, "compacted"))
