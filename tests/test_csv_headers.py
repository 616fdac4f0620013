"""Headers of very many small raw files."""

from py4j.java_gateway import GatewayClient

from tidebar.sources.lake import csv_headers, read_raw_csv


def test_headers_of_many_files_do_not_pass_the_driver_one_by_one(spark, tmp_path, monkeypatch):
    for i in range(300):
        folder = tmp_path / f"t={i % 7} +%{i}"
        folder.mkdir()
        (folder / f"a {i}.csv").write_text("﻿date, close\n1,2\n3,4\n" if i % 2 else "date,open\n5,6\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n7,8\n")
    (tmp_path / "_hidden.csv").write_text("x,y\n1,2\n")
    calls, send = [], GatewayClient.send_command
    monkeypatch.setattr(GatewayClient, "send_command", lambda *a, **k: calls.append(1) or send(*a, **k))
    found = csv_headers(spark, str(tmp_path))
    assert len(calls) < 300  # it took more than ten calls a file
    assert {k: len(v) for k, v in found.items()} == {("date", "close"): 150, ("date", "open"): 150, (): 1}
    raw = read_raw_csv(spark, str(tmp_path))
    assert raw.count() == 450
    assert [raw.selectExpr(f"count({k})").first()[0] for k in ("close", "open")] == [300, 150]


def test_equal_headers_are_read_by_folder(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}" / f"p {i}+.csv").write_text("date,close\n1,2\n3\n")
    (tmp_path / "note.txt").write_text("date,close\n9,9\n")
    raw = read_raw_csv(spark, [str(tmp_path / "0"), str(tmp_path / "1"), str(tmp_path / "2")])
    assert sorted(map(tuple, raw.select("date", "close").collect()), key=str) == sorted([("1", "2"), ("3", None)] * 3, key=str)
    assert raw.select("_path").distinct().count() == 3
