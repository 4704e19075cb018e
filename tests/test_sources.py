"""Sources and sinks: round trips and malformed input."""

import json

import pytest

from fleetlens.operators import priors
from fleetlens.schemas import ALERT
from fleetlens.sources import readers, writers


def test_labelled_csv(spark, tmp_path):
    head = "timestamp,processId,parentProcessId,processName,eventName,returnValue,args,sus,evil"
    args = """"[{'name': 'pathname', 'type': 'const char*', 'value': '/etc/""q""'}]\""""
    (tmp_path / "c.csv").write_text("\n".join([head, f"1.5,7,1,sshd,openat,0,{args},0,0", "2,8,1,cat,close,-1,[],1,0", "3,8,1,cat,close,-1,[],0,1", "4,8,1,,close,x,[],1,1"]) + "\n")
    got = readers.src_labelled_csv(spark, str(tmp_path / "c.csv")).orderBy("timestamp").collect()
    assert [r.label for r in got] == [0, 1, 1, 1]
    assert (got[0].path, got[0].path_prefix, got[1].path, got[1].path_prefix) == ('/etc/"q"', '/etc/"q"', None, "")
    assert got[3].returnValue is None and got[3].processName is None


def test_alert_log(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 5, "a", None, [], 0.5, "m", [], "s")], ALERT)
    writers.sink_alert_log(df, str(tmp_path / "log"))
    writers.sink_alert_log(df, str(tmp_path / "log"))
    assert readers.src_alert_log(spark, str(tmp_path / "log")).count() == 2
    (tmp_path / "bad.json").write_text('{"alert_id": 1}\n\n{"alert_id"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.src_alert_log(spark, str(tmp_path / "bad.json")).collect()


def test_record_log(spark, tmp_path):
    rows = [json.dumps({"record_type": "r", "pid": 1, "ancestry_chain": [{"pid": 1, "ppid": 0}]}), "", json.dumps({"record_type": "x"}), "{oops"]
    (tmp_path / "r.ndjson").write_text("\n".join(rows))
    got = readers.src_record_log(spark, str(tmp_path / "r.ndjson"), "r").collect()
    assert sorted((r.pid or 0, r.reject_line or "") for r in got) == [(0, "{oops"), (1, "")]


def test_catalogue_round_trip(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "open", "/x", 1), ("a", "open", "", 0), (None, "exec", "/x", 0)], "processName string, eventName string, path_prefix string, label int")
    made = priors.prior_catalogue(corpus)
    writers.sink_prior_catalog(made, str(tmp_path / "p"), {"source": "train"})
    again = readers.src_prior_catalog(spark, str(tmp_path / "p"))
    key = lambda r: (r.family, r.token, round(r.rate, 12))
    assert sorted(map(key, again.collect())) == sorted(map(key, made.collect()))
    rates = {(r.family, r.token): r.rate for r in made.collect()}
    assert rates["process", "a"] == pytest.approx((1 + 5 / 3) / 7) and ("process", None) not in rates


def test_generated_events(spark):
    got = readers.src_events_generated(spark, 1000, 50_000).orderBy("event_id").collect()
    assert [r.syscall_type for r in got[:5]] == ["Execve", "Openat", "Connect", "Clone", "Execve"]
    assert got[999].timestamp_ns == 999 * 20_000 and got[300].pid == 4000 + 300 % 256 and got[34].port == 4034


def test_metrics_and_manifest(spark, tmp_path):
    (tmp_path / "model.bin").write_bytes(b"abc")
    writers.sink_metrics(spark.createDataFrame([(0.9, 0.95)], "f1 double, tpr double"), str(tmp_path / "m"))
    writers.sink_manifest(spark, str(tmp_path / "man"), 7, {"priors": "train"}, {"depth": [3]}, [str(tmp_path / "model.bin")])
    r = spark.read.json(str(tmp_path / "man")).first()
    assert r.seed == 7 and r.artifacts[0].sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert spark.read.json(str(tmp_path / "m")).first().f1 == 0.9


def test_feature_json(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"pid": 3, "total_syscalls": 4, "wrote_etc": True, "bigrams": {"Openat->Openat": 1.0}}, indent=1))
    r = readers.src_feature_json(spark, str(tmp_path / "v.json")).first()
    assert (r.pid, r.wrote_etc, r.bigrams) == (3, True, {"Openat->Openat": 1.0})
