import json

from gaugeworks import cli


def log(path, answers):
    rows = [
        {"run_id": path.stem, "item_id": f"i{k}", "axis": "A1" if k % 2 else "A3", "answer_format": "mcq", "options": {"A": "x", "B": "y"}, "gold_answer": "A", "status": "ok" if a else "error", "answer": a, "system": {"system_id": "s", "context_mode": "blind"}}
        for k, a in enumerate(answers)
    ]
    path.write_text("\n".join(map(json.dumps, rows)))
    return str(path)


def test_report_and_compare(spark, tmp_path):
    a, b = log(tmp_path / "a.jsonl", ["A", "A", "A", None]), log(tmp_path / "b.jsonl", ["B", "A", "B", "A"])
    code, rows = cli.run(spark, ["report", a, "--out", str(tmp_path / "r.json")])
    assert code == 0 and rows[0]["n"] == 4 and rows[0]["mean"] == 0.75
    assert [r["axis"] for r in rows[1:]] == ["A1", "A3"] and (tmp_path / "r.json").exists()
    code, rows = cli.run(spark, ["compare", a, b])
    overall = next(r for r in rows if r["axis"] == "overall")
    assert code == 0 and overall["n_paired"] == 3 and overall["n_dropped"] == 1
    (tmp_path / "e.jsonl").write_text("")
    assert cli.run(spark, ["compare", a, str(tmp_path / "e.jsonl")])[0] == 2


GOOD = [
    ("ready", {"system_id": "model-1", "context_mode": "memory"}), ("ingest", {"session_id": "a"}), ("ingest_ack", {"session_id": "a"}), ("ingest_end", {}), ("ingest_end_ack", {}),
    ("query", {"item_id": "q"}), ("answer", {"item_id": "q"}), ("env_end", {}), ("env_end_ack", {}), ("unknown", {}), ("pong", {}),
]


def exchange(path, **systems):
    rows = [{"system": name, "seq": k, "type": kind, **more} for name, told in systems.items() for k, (kind, more) in enumerate(told)]
    path.write_text("\n".join(map(json.dumps, rows)))
    return str(path)


def test_verify_adapter(spark, tmp_path, capsys):
    log = exchange(tmp_path / "good.jsonl", good=GOOD)
    assert cli.main(["verify-adapter", log], spark) == 0
    said = capsys.readouterr().out
    assert "[PASS] good: handshake\n" in said and "10/10 checks passed\n" in said
    (tmp_path / "held.jsonl").write_text('{"system": "good", "path": "/stage/a.mp4"}')
    assert cli.main(["--json", "verify-adapter", log, "--held", str(tmp_path / "held.jsonl")], spark) == 1
    failed = [r["check"] for r in map(json.loads, capsys.readouterr().out.splitlines()) if not r["passed"]]
    assert failed == ["releases_media"]
    oracle = [("ready", {"system_id": " System ", "context_mode": "oracle"}), *GOOD[1:6], ("answer", {"item_id": "other"}), *GOOD[7:10]]
    log = exchange(tmp_path / "bad.jsonl", oracle=oracle, mute=GOOD[1:], stuck=[("ready", {"system_id": "s", "context_mode": "x"}), GOOD[2], *GOOD[1:2], *GOOD[3:]], good=GOOD[:2] * 1 + GOOD[2:])
    code, rows = cli.run(spark, ["verify-adapter", log, "--held", str(tmp_path / "held.jsonl")])
    told = {}
    for r in rows:
        told.setdefault(r["system"], {})[r["check"]] = r["passed"]
    assert code == 1 and told["mute"] == {"handshake": False}
    assert told["stuck"] == {"handshake": True, "declares_context_mode": False, "specific_system_id": True, "ingest_acknowledged": False, "survives_unknown": True}
    assert [c for c, ok in told["oracle"].items() if not ok] == ["specific_system_id", "answers_all", "echoes_ids", "survives_unknown"]
    (tmp_path / "none.jsonl").write_text("")
    assert cli.run(spark, ["verify-adapter", str(tmp_path / "none.jsonl")]) == (2, [])


def test_tables_are_aligned():
    rows = [{"axis": "A1", "n": 10, "mean": 0.5}, {"axis": "longer", "n": 7, "mean": None}, {"notes": ["a", "b"]}]
    assert cli.table(rows) == ["axis     n   mean", "-----------------", "A1      10  0.500", "longer   7      -", "", "notes", "-----", "a; b"]
    assert cli.table([]) == []
