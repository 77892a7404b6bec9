"""Run folds, their streaming twins, and file sources."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.operators import runs as R
from strataforge.sources import files as S
from strataforge.streaming import runs as streams

FIELDS = "run_id bigint, sequence bigint, stage string, operation string, tool_name string, normalized_arguments_hash string, target_resource_hash string, error_code string, output_hash string, artifact_count bigint, successful boolean"


def _signals(run, **columns):
    n = len(next(iter(columns.values())))
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return [tuple({"run_id": run, "sequence": i + 1}.get(k, columns.get(k, [None] * n)[i] if k in columns else None) for k in names) for i in range(n)]


CASES = {
    "SAME_ERROR_REPEAT": {"error_code": ["e"] * 3, "operation": ["a", "b", "c"]},
    "SAME_RESOURCE_REPEAT": {"target_resource_hash": ["r"] * 3, "operation": ["a", "b", "c"]},
    "SAME_OPERATION_REPEAT": {"operation": ["o"] * 3, "target_resource_hash": ["a", "b", "c"]},
    "STAGE_REENTRY_WITHOUT_PROGRESS": {"stage": ["A", "B", "A", "B", "A"], "operation": list("abcde")},
    "NO_ARTIFACT_GROWTH": {"operation": ["a", "b", "c"]},
}


@pytest.mark.parametrize("reason", CASES)
def test_progress_rules(spark, reason):
    df = spark.createDataFrame(_signals(1, **CASES[reason]), FIELDS)
    last = R.replay_progress(df).orderBy("sequence").collect()[-1]
    assert last["no_progress"] and last["reason"] == reason and last["emit"] == (reason != "STAGE_REENTRY_WITHOUT_PROGRESS") or last["reason"] == reason


def test_growth_resets_the_latch(spark):
    df = spark.createDataFrame(_signals(1, artifact_count=[0, 0, 0, 1, 1], operation=list("abcde")), FIELDS)
    got = R.replay_progress(df).orderBy("sequence").collect()
    assert [r["no_progress"] for r in got] == [False, False, True, False, False] and got[3]["progress"]
    assert R.replay_progress(df.limit(0)).count() == 0


def _ledger(spark):
    rows = [
        (1, 1, "reserve", "a", json.dumps({"tool": 1})), (1, 2, "commit", "a", None), (1, 3, "reserve", "b", json.dumps({"tool": 1, "search": 1})), (1, 4, "reserve", "c", json.dumps({"tool": 1})),
        (1, 5, "reserve", "d", json.dumps({"tool": 1})), (1, 6, "release", "c", None), (1, 7, "reserve", "d", json.dumps({"tool": 1})), (1, 8, "commit", "zz", None),
    ]
    return spark.createDataFrame(rows, "run_id bigint, seq bigint, action string, reservation_id string, costs string")


def test_budget_rules(spark):
    got = R.replay_budget(_ledger(spark), {"tool": 2, "search": 0}).orderBy("seq").collect()
    assert [r["accepted"] for r in got] == [True, True, False, True, False, True, True, False]
    assert got[2]["refused_on"] == "search" and json.loads(got[1]["committed"]) == {"tool": 1}


def test_streams_equal_batches(spark, tmp_path):
    signals = spark.createDataFrame(sum((_signals(i, **c) for i, c in enumerate(CASES.values())), []), FIELDS)
    signals.where("sequence <= 2").coalesce(1).write.json(str(tmp_path / "in"))
    name = f"progress{abs(hash(tmp_path))}"
    query = streams.progress_stream(spark.readStream.schema(signals.schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, R.replay_progress(signals.where("sequence <= 2")).collect()))
    ledger = _ledger(spark)
    ledger.coalesce(1).write.json(str(tmp_path / "led"))
    query = streams.budget_stream(spark.readStream.schema(ledger.schema).json(str(tmp_path / "led")), {"tool": 2, "search": 0}).writeStream.format("memory").queryName(name + "b").option("checkpointLocation", str(tmp_path / "cp2")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(str, spark.table(name + "b").collect())) == sorted(map(str, R.replay_budget(ledger, {"tool": 2, "search": 0}).collect()))


def test_trace_sink_writes_each_event_once(spark, tmp_path):
    rows = spark.createDataFrame([("e1", 1), ("e1", 1), ("e2", 2)], "event_id string, n int")
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
    streams.append_trace(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.schema(rows.schema).json(str(tmp_path / "out")).count() == 2


def test_window_forms(spark):
    df = spark.createDataFrame([(1, i, s, v) for i, (s, v) in enumerate([("a", 0), ("b", 0), ("b", 2), ("b", 1)])] + [(2, 1, None, 5)], "run int, at int, stage string, v int")
    assert {tuple(r) for r in R.last_streak(df, "run", ["at"], "stage").collect()} == {(1, "b", 3), (2, None, 1)}
    assert {tuple(r) for r in R.stage_entries(df, "run", ["at"], "stage").collect()} == {(1, "a", 1), (1, "b", 1), (2, None, 1)}
    assert [r["grew"] for r in R.growth(df, "run", ["at"], F.col("v")).where("run = 1").orderBy("at").collect()] == [False, False, True, False]
    assert [r["within"] for r in R.running_budget(df, "run", ["at"], F.col("v"), 2).where("run = 1").orderBy("at").collect()] == [True, True, True, False]


def test_markdown_sections():
    text = "intro\n# API\n## Workflow\n### Recovery\nDefault: retry\n\n" + "x" * 2600 + "\n\ntail\n# Next\n```\n# in fence\n```"
    got = S.markdown_sections(text)
    assert got[0] == ("", [], "intro") and got[1] == ("Recovery", ["API", "Workflow", "Recovery"], "Default: retry")
    assert [len(p[2]) for p in got[2:5]] == [1250, 1250, 100 + 2 + 4] and got[-1][1] == ["in fence"]
    assert S.packed_paragraphs("aa\n\nbb\n\ncccc", 6) == ["aa\n\nbb", "cccc"] and S.packed_paragraphs("aaaa\n\nbbbb", 5, 2) == ["aaaa", "aabbbb"]


def _docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f"<w:p><w:pPr>{f'<w:pStyle w:val={chr(34)}{style}{chr(34)}/>' if style else ''}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("One", "Heading1") + p("text") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# T\nline\nmore\n\nlast")
    (tmp_path / "docs" / "b.docx").write_bytes(_docx())
    (tmp_path / "docs" / "c.md").write_bytes(b"\xff\xfe\xff")
    rows = {(r["path"].rsplit("/", 1)[-1], r["kind"], r["line_start"], r["text"]) for r in S.read_documents(spark, str(tmp_path / "docs")).collect() if r["kind"] != "error"}
    assert {("a.md", "block", 1, "# T"), ("a.md", "block", 2, "line\nmore"), ("a.md", "block", 5, "last"), ("b.docx", "heading", None, "One"), ("b.docx", "row", None, "a | b")} <= rows
    bodies = S.read_bodies(spark, str(tmp_path / "docs"), "*.md")
    assert bodies.where("text is null").count() == 1
    checked = S.verified_bodies(bodies, bodies.select("path", F.lit("no").alias("sha256")))
    assert checked.where("intact").count() == 0
    images = S.image_references(spark.createDataFrame([(1, "# H\n![a](x.png) and <img src='y.svg'>"), (2, None)], "i int, t string"), "i", "t").collect()
    assert {(r["heading"], r["line"], r["target"]) for r in images} == {("H", 2, "x.png"), ("H", 2, "y.svg")}
    assert S.resolve_path("docs/a/b.md", "../i/x.png#f") == "docs/i/x.png" and S.resolve_path("a.md", "../../x") is None and S.resolve_path("a.md", "http://x") is None
    np.save(tmp_path / "v.npy", np.eye(3, dtype="float32"))
    ids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos bigint, id string")
    assert [r["vector"] for r in S.read_vectors(spark, str(tmp_path / "v.npy"), ids).orderBy("pos").collect()] == np.eye(3).tolist()
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a"}\n{"chunk_id": "a"}\n')
    assert S.read_chunk_lines(spark, str(tmp_path / "c.jsonl"))[1].count() == 1


def test_published_tables(spark, tmp_path):
    for n in (1, 2):
        S.publish(spark.range(n), str(tmp_path), n)
        assert S.published(spark, str(tmp_path)).count() == n
