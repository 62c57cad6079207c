"""The stream of numbered rows: order by name, skipped rows, chunks, restarts, growing files, odd files."""

import pytest

from rillwatch.errors import DataError
from rillwatch.streaming import jobs, row_files

SCHEMA = "id long, text string, x double"


def run(spark, folder, name="rows", **options):
    stream = row_files.stream_rows(spark, str(folder / "in"), SCHEMA, **options)
    jobs.start(stream, jobs.append_table(str(folder / name)), str(folder / f"{name}-progress")).awaitTermination()
    return {(r["_file"], r["_row"]): (r["_chunk"], r["id"], r["text"], r["x"]) for r in jobs.read_runs(spark, str(folder / name)).collect()}


def test_rows_chunks_and_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = lambda a, b: "".join(f'{k},"t, {k}",{k / 2}\n' for k in range(a, b))
    (folder / "b.csv").write_text("id,text,x\n" + lines(0, 25))
    (folder / "a.csv").write_text("x,id,text,more\n" + "".join(f"{k / 2},{k},t{k},z\n" for k in range(100, 112)))
    (folder / "_hidden.csv").write_text("id,text,x\n1,a,1\n")
    (folder / "c.txt").write_text("id,text,x\n1,a,1\n")
    want = {("a.csv", k - 100): ((k - 103) // 10, k, f"t{k}", k / 2) for k in range(103, 112)}
    want |= {("b.csv", k): ((k - 3) // 10, k, f"t, {k}", k / 2) for k in range(3, 25)}
    assert run(spark, tmp_path, skip_rows=3, chunk_rows=10) == want
    assert run(spark, tmp_path, skip_rows=3, chunk_rows=10) == want  # nothing new
    with (folder / "b.csv").open("a") as grown:
        grown.write(lines(25, 40))
    (folder / "d.csv").write_text("id,text,x\n7,,\n")
    (folder / "e.csv").write_text("id,text,x\n" + lines(0, 4) + "9,,nan\n")
    want |= {("b.csv", k): ((k - 3) // 10, k, f"t, {k}", k / 2) for k in range(25, 40)}
    want |= {("e.csv", 3): (0, 3, "t, 3", 1.5), ("e.csv", 4): (0, 9, None, None)}
    assert run(spark, tmp_path, skip_rows=3, chunk_rows=10) == want


def test_json_lines_and_empty_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id": 1, "text": "a"}\n\nbroken\n[1]\n{"x": 2.5, "other": 1}')
    (folder / "b.jsonl").write_text("")
    assert run(spark, tmp_path, pattern="*.jsonl") == {("a.jsonl", 0): (0, 1, "a", None), ("a.jsonl", 1): (0, None, None, 2.5)}
    (folder / "c.csv").write_text("")
    assert run(spark, tmp_path, "csv", pattern="*.csv") == {}


def test_wrong_options(spark):
    for options in ({"pattern": "*.xml"}, {"skip_rows": -1}, {"chunk_rows": 0}):
        with pytest.raises(DataError):
            row_files.stream_rows(spark, "/tmp", SCHEMA, **options)
    with pytest.raises(DataError):
        row_files.stream_rows(spark, "/tmp", "_row long")
