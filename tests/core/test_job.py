"""A run from source to export on a small fixture: batches, flags, reviews, gate, and starting again."""

import pytest

from weftline.sources import files, tables
from weftline.sources.versions import Change
from weftline.streaming import incremental
from weftline.streaming.job import Job, JobError

HEAD = "<table><tr><th>Группа ГСМ</th><th>Основная марка</th><th>Дублирующая марка</th><th>Резервная марка</th><th>Зарубежная марка</th><th>Наземная техника</th></tr>"
ROWS = [
    ("Масла", "А-1 по ГОСТ 10", "Д-1 по ТУ 1", "", "", "+"),
    ("", "Б-1 по ГОСТ 11", "", "", "", "-"),
    ("", "В-1 по ГОСТ 12<br>В-2 по ГОСТ 13", "", "Р-1 по ТУ 2<br>Р-2 по ТУ 3<br>Р-3 по ТУ 4", "", ""),
    ("Смазки", "", "Д-2 по ТУ 5", "", "", "?"),
    ("", "А-1 по ГОСТ 10", "", "", "X по ISO 1", "нет"),
]
PURPOSES = "<table><tr><th>Марка ГСМ</th><th>Назначение</th></tr>" + "".join(f"<tr><td>{m}</td><td>{p}</td></tr>" for m, p in [("А-1 по ГОСТ 10", "для  двигателей"), ("Б-1 по ГОСТ 11", "одно"), ("Б-1 по ГОСТ 11", "другое"), ("В-1", "прочее")]) + "</table>"


@pytest.fixture()
def job(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.html").write_text(HEAD + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in ROWS) + "</table>" + PURPOSES, encoding="utf-8")
    return Job(spark, str(tmp_path / "job")), str(tmp_path / "src")


def test_run_reviews_and_export(spark, job, tmp_path):
    run, source = job
    assert run.progress() == {"status": "not_initialized"}
    with pytest.raises(JobError):
        run.process()
    began = run.initialize(source)
    assert began["status"] == "initialized" and began["total_rows"] == 5 and began["total_cells"] == 8
    assert run.initialize(source)["status"] == "already_initialized"
    with pytest.raises(JobError):
        run.initialize(str(tmp_path))
    assert run.table("catalog").count() == 2 and all(len(r.preview) <= 5 for r in run.table("catalog").collect())

    first = run.process(batch_size=2, max_batches=2)
    assert [(b["batch_id"], b["start_row_id"], b["end_row_id"], b["qc_status"]) for b in first] == [("B000001", "R000001", "R000002", "passed_with_flags"), ("B000002", "R000003", "R000004", "passed_with_flags")]
    state = run.progress()
    assert state["processed_rows"] == 4 and state["remaining_rows"] == 1 and state["next_batch"] == "B000003" and state["status"] == "in_progress"
    assert state["flag_categories"]["ambiguous_purpose_match"] == 1 and state["flag_categories"]["ambiguous_relation_mapping"] == 1 and state["flag_categories"]["missing_main_item"] == 1
    assert [b["batch_id"] for b in run.process(batch_size=2, max_batches=5)] == ["B000003"] and run.process() == []
    assert run.progress()["status"] == "completed" and "## B000003" in run.report()
    flags = run.flags().orderBy("flag_id").collect()
    assert [f.flag_id for f in flags if f.batch_id == "B000001"] == [f"B000001:F{k:04}" for k in range(1, 1 + sum(f.batch_id == "B000001" for f in flags))]
    assert next(f.message for f in flags if f.category == "unrecognized_ground_equipment_marker").startswith("Маркер")

    with pytest.raises(JobError):
        run.export(str(tmp_path / "out"))
    told = {(b.category, b.row_id) for b in run.blockers().collect()}
    assert told == {("ambiguous_purpose_match", "R000002"), ("ambiguous_relation_mapping", "R000003"), ("missing_main_item", "R000004")}
    item = lambda row, role, n=1: f"R00000{row}.{role}.0{n}"
    run.override_purpose("B000001", item(2, "main"), purpose_text=" одно  и то же ")
    for k in (1, 2, 3):
        run.override_relation("B000002", item(3, "main"), item(3, "reserve", k))
    with pytest.raises(JobError):
        run.override_relation("B000002", item(4, "duplicate"), item(4, "duplicate"))
    with pytest.raises(JobError):
        run.override_item("B000002", item(1, "main"), brand="x")
    assert {b.category for b in run.blockers().collect()} == {"missing_main_item"}
    run.override_item("B000001", item(1, "duplicate"), brand="Д-10", no_document=True)
    detail = run.row_detail("R000001")
    assert [i["brand"] for i in detail["items"]] == ["А-1", "Д-10"] and detail["relations"][0]["related_brand"] == "Д-10" and detail["batch_id"] == "B000001"
    run.clear_override("items", "B000001", item_id=item(1, "duplicate"))
    assert run.row_detail("R000001")["items"][1]["brand"] == "Д-1"
    with pytest.raises(JobError):
        run.row_detail("R000099")

    out = run.export(str(tmp_path / "out"), allow_blockers=True)
    assert out["rows"] == {"brands.csv": 9, "groups.csv": 9, "relations.csv": 5} or out["rows"]["brands.csv"] == 10
    lines = (tmp_path / "out" / "brands.csv").read_text(encoding="utf-8").split("\n")
    assert lines[0].startswith("Марка ГСМ;Нормативный документ") and "А-1;ГОСТ 10;для двигателей;+;;" in lines and "Б-1;ГОСТ 11;одно и то же;-;;" in lines
    related = (tmp_path / "out" / "relations.csv").read_text(encoding="utf-8").split("\n")
    assert "А-1;Дублирующая;Д-1;" in related and "А-1;Зарубежная;X;" in related

    again = run.initialize(source, force=True)
    assert again["status"] == "initialized" and again["processed_rows"] == 0 and run.flags().count() == 0


def test_batches_that_stop(spark, job):
    run, source = job
    run.initialize(source)
    assert len(run.process(batch_size=1, max_batches=5, stop_on_flags=True)) == 1
    state = run.progress()
    assert state["processed_rows"] == 1 and run.table("table1").select("batch_id").distinct().count() == 1


def test_stream_ends_after_so_many_batches(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("src", "out", "cp"))
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(src)
    double = lambda df: df.selectExpr("id", "id * 2 as v")
    assert incremental.run_stream(spark, src, "id long", out, cp, double, max_batches=2) == 2
    assert spark.read.parquet(out).count() == 20
    bad = incremental.run_stream(spark, src, "id long", out, cp, double, passes=lambda df: df.where("id % 10 = 3").isEmpty())
    assert bad == 0
    assert incremental.run_stream(spark, src, "id long", out, cp, double) == 2
    assert spark.read.parquet(out).selectExpr("count(*)", "count(distinct id)").first()[:] == (40, 40)


def test_sinks(spark, tmp_path):
    d = str(tmp_path)
    df = spark.createDataFrame([("a;b", None), ('say "x"', " z ")], "p string, q string")
    files.write_csv_file(df.coalesce(1), f"{d}/one.csv", ["P", "Q"])
    assert open(f"{d}/one.csv", encoding="utf-8").read() == 'P;Q\n"a;b";\n"say ""x"""; z \n'
    files.write_csv_file(df.limit(0), f"{d}/one.csv", ["P", "Q"])
    assert open(f"{d}/one.csv", encoding="utf-8").read() == "P;Q\n"
    (tmp_path / "cat.csv").write_text("A,B\nx,y\n", encoding="utf-8")
    files.write_catalog(df.coalesce(1), f"{d}/cat.csv", ["A", "B"])
    raw = (tmp_path / "cat.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfA,B\n") and b"a;b,\n" in raw
    assert files.read_json(spark, f"{d}/none.json", 7) == 7
    files.write_json(spark, f"{d}/x.json", {"ё": 1})
    assert files.read_json(spark, f"{d}/x.json") == {"ё": 1} and not [n for n in tmp_path.iterdir() if n.name.startswith(".x.json") and not n.name.endswith(".crc")]
    for _ in range(2):
        files.write_jsonl(df.coalesce(1), f"{d}/log", append=True)
    lines = sorted(r.value for r in spark.read.text(f"{d}/log").collect())
    assert lines == sorted(['{"p":"a;b","q":null}', '{"p":"say \\"x\\"","q":" z "}'] * 2)
    assert files.checked_jsonl(spark, f"{d}/log").count() == 4
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n\n[1]\n')
    with pytest.raises(ValueError):
        files.checked_jsonl(spark, f"{d}/bad.jsonl")
    (tmp_path / "own.csv").write_text("A,B\nx,y\nz,w\n", encoding="utf-8")
    got = files.Reloaded(spark, f"{d}/own.csv", files.read_csv)
    assert got().count() == 2 and got() is got()
    (tmp_path / "own.csv").write_text("A,B\nx,y\n", encoding="utf-8")
    assert got().count() == 1
    (tmp_path / "rel.csv").write_text("Первая;Тип;Вторая\na;t;b\n;;\n", encoding="utf-8")
    rel = files.relations_of(files.read_csv(spark, f"{d}/rel.csv"), ("Первая", "Тип", "Вторая"), "Примечание").collect()
    assert [(r.first, r.type, r.second, r.note) for r in rel] == [("a", "t", "b", "")]
    with pytest.raises(ValueError):
        files.relations_of(files.read_csv(spark, f"{d}/rel.csv"), ("Первая", "Вид", "Вторая"), "Примечание")


def test_a_batch_that_fails_half_way_leaves_the_run_as_it_was(spark, job, monkeypatch):
    run, source = job
    run.initialize(source)
    real, left = Change._segment, [5]

    def segment(self, name, df, batches):
        left[0] -= 1
        if left[0] == 0:
            raise OSError("no space")
        return real(self, name, df, batches)

    monkeypatch.setattr(Change, "_segment", segment)
    with pytest.raises(OSError):
        run.process(batch_size=2)
    again = Job(spark, run.store.folder)
    assert again.progress() == run.progress() and again.progress()["processed_rows"] == 0 and not again.store.has("table1")
    assert [b["batch_id"] for b in again.process(batch_size=2)] == ["B000001"] and again.progress()["processed_rows"] == 2


def grid(rows):
    return HEAD + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def everything(run):
    """All tables of a run but for what names files by time, and the state."""
    names = ("rows", "cells", "purposes", "catalog", "staged_rows", "table1", "table2", "table3", "flags", "qc")
    return {n: sorted((str(r.asDict(True)) for r in run.table(n).collect())) for n in names}, run.progress()


def test_a_changed_file_is_read_alone_and_gives_what_a_new_start_gives(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.html").write_text(grid(ROWS[:3]), encoding="utf-8")
    (src / "b.html").write_text(grid(ROWS[3:]), encoding="utf-8")
    (src / "p.html").write_text(PURPOSES, encoding="utf-8")
    run = Job(spark, str(tmp_path / "job"))
    run.initialize(str(src))
    run.process(batch_size=2, max_batches=3)
    assert run.refresh() == {"files": 0, "gone": 0, "batches": []}
    (src / "b.html").write_text(grid([("", "Г-1 по ГОСТ 77", "", "", "", "+"), ROWS[4]]), encoding="utf-8")
    read = []
    real = tables.parsed_tables
    monkeypatch.setattr(tables, "parsed_tables", lambda files: (read.extend(r.path.rsplit("/", 1)[1] for r in files.select("path").collect()), real(files))[1])
    # the group of the first file's last row reaches into the second file now, down to its last row
    assert run.refresh() == {"files": 1, "gone": 0, "batches": ["B000002", "B000003"]} and read == ["b.html"]
    assert [r.group for r in run.table("rows").where("row_index > 3").collect()] == ["Масла"] * 2
    fresh = Job(spark, str(tmp_path / "fresh"))
    fresh.initialize(str(src))
    fresh.process(batch_size=2, max_batches=3)
    (got, state), (want, started) = everything(run), everything(fresh)
    assert state == started
    for name in want:
        assert got[name] == want[name], name
