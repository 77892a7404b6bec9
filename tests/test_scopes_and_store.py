"""Scopes, the version store, decoded JSON, safe texts and figures on small tables with nulls, ties and repeats."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.functions import checked as C
from strataforge.functions.rules import hashed_vector, hashed_vectors
from strataforge.operators import evidence as E
from strataforge.operators import index as I
from strataforge.operators import retrieval as R
from strataforge.operators import runs
from strataforge.operators import scopes as S
from strataforge.operators.version_store import VersionStore
from strataforge.sources import files


def test_scopes_are_checked_when_made():
    assert S.Scope(project_ids=("  Ａ  b ",)).project_ids == ("A b",)
    for bad in ({"project_ids": (" ",)}, {"document_ids": ("a", "ａ")}, {"version_ids": ("v1",)}):
        with pytest.raises(ValueError):
            S.Scope(**bad)
    assert S.Scope().fingerprint() == S.Scope().fingerprint() != S.Scope(document_ids=("a",)).fingerprint()
    known = {"v1", "v2"}
    assert S.version_members("current", known, "v2") == {"v2"} and S.version_members("all", known, "v2") is None
    assert S.version_members("both", known, "v2", {"both": ["v1", "v2"]}) == known
    for bad, sets in (("v3", {}), ("x", {"x": []}), ("x", {"x": ["v9"]})):
        with pytest.raises(ValueError):
            S.version_members(bad, known, "v2", sets)


def test_evidence_and_language_choice(spark):
    rows = spark.createDataFrame([(1, "v1", "ACTIVE", "a"), (2, "v1", "SUPERSEDED", "a"), (3, None, None, "a"), (4, "v2", None, "b"), (5, None, None, None)], "id int, version_id string, version_status string, project_id string")
    assert {r["id"] for r in S.evidence_scope(rows, S.Scope()).collect()} == {1, 3, 5}
    assert {r["id"] for r in S.evidence_scope(rows, S.Scope(project_ids=("a",))).collect()} == {1, 3}
    own = spark.createDataFrame([("f", 1, "en"), ("f", 2, "zh"), ("f", 3, "zh"), ("g", 4, "en"), ("g", 5, None), ("h", 6, None)], "k string, at int, language string")
    assert {(r["k"], r["at"]) for r in S.one_for_each(own, ["k"], "language", ["at"]).collect()} == {("f", 3), ("g", 4), ("h", 6)}
    assert S.one_for_each(own.limit(0), ["k"], "language", ["at"]).count() == 0
    with pytest.raises(LookupError):
        S.document_rows(own.withColumnRenamed("k", "document_id"), "none")


def test_version_store(spark, tmp_path):
    store = VersionStore(spark, f"file://{tmp_path}/store", lambda c: hashed_vector(c))

    def version(document, name, source):
        return spark.createDataFrame([(document, name, "p", "t", source)], "document_id string, version_id string, project_id string, document_type string, source_hash string")

    def sections(name, *texts):
        return spark.createDataFrame([(name, f"s{i}", i, t) for i, t in enumerate(texts)], "version_id string, section_path string, position int, content string")

    assert store.versions.count() == 0 and store.faults().count() == 0
    first = store.ingest(version("d", "d1", "h1"), sections("d1", "alpha", "beta", "gamma")).first()
    assert (first["added"], first["new_vectors"]) == (3, 3)
    second = store.ingest(version("d", "d2", "h2"), sections("d2", "alpha", "BETA changed", "gamma", "alpha")).first()
    assert (second["unchanged"], second["modified"], second["added"], second["removed"], second["new_vectors"]) == (2, 1, 1, 0, 1)
    assert {(r["version_id"], r["status"], r["previous_version_id"]) for r in store.versions.collect()} == {("d1", "SUPERSEDED", None), ("d2", "ACTIVE", "d1")}
    for bad in ((version("d", "d2", "h9"), sections("d2", "x")), (version("d", "d3", "h1"), sections("d3", "x")), (version("d", "d3", "h3"), sections("d3")), (version("d", "d3", "h3").withColumn("project_id", F.lit("q")), sections("d3", "x"))):
        with pytest.raises(ValueError):
            store.ingest(*bad)
    assert store.faults().count() == 0 and store.active.count() == 4
    query = spark.createDataFrame([(1, "alpha")], "query_id int, t string").select("query_id", hashed_vector("t").alias("vector"))
    hits = [(r["version_id"], r["position"]) for r in store.search(query, S.Scope(), 2).orderBy("rank").collect()]
    assert hits == [("d2", 0), ("d2", 3)]
    old = store.search(query, S.Scope(version_ids=("d1",), active_only=False), 1).first()
    assert (old["version_id"], old["position"], old["score"]) == ("d1", 0, 1.0)
    store.activate("d1")
    assert {r["version_id"] for r in store.versions.where("status = 'ACTIVE'").collect()} == {"d1"}
    with pytest.raises(LookupError):
        store.activate("none")


def test_decoded_json():
    good = {"claims": [{"text": " a ", "evidence_ids": ["x", "y"]}, {"text": "b", "evidence_ids": ["x"]}], "relevant_sources": [{"document_id": "d", "page_number": 1}]}
    assert C.answer_of(json.dumps(good)) == {"valid": True, "claims": 2, "cited": ["x", "y", "x"], "final_answer": "a\nb"}
    assert C.answer_of('{"claims": [], "relevant_sources": []}')["final_answer"] == "N/A"
    claim, page = good["claims"][0], good["relevant_sources"][0]
    for bad in (None, "", "[]", "{", good | {"more": 1}, good | {"claims": [claim] * 2}, good | {"claims": [claim | {"evidence_ids": []}]}, good | {"claims": [claim | {"evidence_ids": ["x", "x"]}]}, good | {"claims": [claim | {"text": " "}]},
                good | {"claims": [claim | {"text": "x" * 1001}]}, good | {"relevant_sources": [page | {"page_number": True}]}, good | {"relevant_sources": [page | {"page_number": 0}]}):
        assert not C.answer_of(json.dumps(bad) if isinstance(bad, dict) else bad)["valid"]
    candidate = {"evidence_chunk_id": "x", "reason": "r", "suggested_action": "s"}
    review = {"change_interpretation": "", "impact_candidates": [candidate], "evidence_gaps": [], "version_ambiguities": ["a"], "reviewer_actions": [], "review_status": "REQUIRES_HUMAN_REVIEW"}
    assert C.review_of(json.dumps(review)) == {"valid": True, "candidates": ["x"]}
    for bad in (review | {"review_status": "DONE"}, review | {"impact_candidates": [candidate] * 2}, review | {"evidence_gaps": [""]}, review | {"evidence_gaps": ["a"] * 9}, review | {"change_interpretation": None}):
        assert not C.review_of(json.dumps(bad))["valid"]
    assert C.canonical_json('{"b": 1, "a": [1, {"d": "é", "c": null}]}') == '{"a":[1,{"c":null,"d":"é"}],"b":1}' and C.canonical_json("{") is None is C.canonical_json(None)


def test_safe_texts_and_classes(spark):
    assert C.safe_text_of("see HTTPS://User:pw@Example.com:8080/a?x=1#y). token=abc, Bearer abc.def sk-12345678") == "see https://example.com:8080/a?[REDACTED_QUERY]). token=[REDACTED], Bearer [REDACTED] [REDACTED]"
    assert C.safe_text_of("x" * 12, 10).startswith("x" * 10 + "… [truncated sha256=")
    assert C.safe_value({"API-Key": 1, "a": ["password: x", 2], "my_token": [1], "n": list(range(60))}, items=3) == {"API-Key": "[REDACTED]", "a": ["password: [REDACTED]", 2], "my_token": "[REDACTED]", "n": [0, 1, 2, {"truncated_items": 57}]}
    rows = spark.createDataFrame([("HTTP 429 Too Many", None), ("read timed out", None), ("", None), (None, None), ("x", 503), ("x", 404), ("x", 408)], "m string, s int")
    got = [(r[0]["code"], r[0]["retryable"]) for r in rows.select(C.error_class(F.col("m"), F.col("s"))).collect()]
    assert got == [("RATE_LIMITED", True), ("OPERATION_TIMEOUT", True), ("INTERNAL_ERROR", False), ("INTERNAL_ERROR", False), ("EXTERNAL_SERVICE_FAILED", True), ("EXTERNAL_SERVICE_FAILED", False), ("OPERATION_TIMEOUT", True)]
    text = spark.createDataFrame([("a ![ x ](u) b ![](v) <img src='q' alt=\"l m\"> <IMG src=z>",)], "t string").select(C.figure_notices(F.col("t"))).first()[0]
    assert text.count("「未命名配图」") == 2 and "「x」" in text and "「l m」" in text and "![" not in text and "<" not in text
    urls = spark.createDataFrame([("HTTPS://u:p@Host.Example:81/p?q",), ("ftp://x",), (None,)], "u string").select(C.url_summary(F.col("u")).alias("s")).select("s.*").collect()
    assert (urls[0]["type"], urls[0]["scheme"], urls[0]["host"]) == ("url", "https", "host.example:81") and urls[1]["type"] == urls[2]["type"] == "invalid_url"
    over = spark.createDataFrame([("Check the Zone-Blend guide of zone", "guides/zone_blend", None)], "q string, k string, h string").select(C.path_overlap(F.col("q"), F.col("k"), F.col("h"))).first()[0]
    assert over == 2


def test_images_context_and_evidence_choice():
    def row(pos, document):
        return {"pos": pos, "document": document}

    hits = [row(1, "a"), row(2, "b"), row(3, "a")]
    assert [r["pos"] for r in E.merge_images(hits, [row(9, "b"), row(9, "b"), row(8, "c"), row(7, "d")], 3)] == [1, 9, 8]
    assert [r["pos"] for r in E.merge_images([row(1, "a")], [row(5, "b")], 2)] == [1, 5] and E.merge_images([], [], 3) == []
    around = {1: [{"pos": 5, "cost": 4}, {"pos": 6, "cost": 9}, {"pos": 7, "cost": 1}]}
    out = E.expand_context([{"pos": 1, "cost": 3}, {"pos": 5, "cost": 4}, {"pos": 2, "cost": 5}, {"pos": 3, "cost": 1}], around, 9)
    assert [r["pos"] for r in out] == [1, 5, 7]


def test_index_is_built_once_and_anew_for_changed_files(spark, tmp_path):
    def save(rows):
        spark.createDataFrame(rows, "pos bigint, content string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/c")
        return spark.read.parquet(f"{tmp_path}/c")

    df = save([(1, "Ｆull Straße 人口数"), (2, None), (3, ""), (None, "x")])
    own = R.corpus_index(df)
    assert R.corpus_index(spark.read.parquet(f"{tmp_path}/c")) is own
    assert {(r["pos"], r["term"], r["tf"], r["length"]) for r in own.collect()} == {(1, None, 0, 4), (1, "full", 1, 4), (1, "strasse", 1, 4), (1, "人口", 1, 4), (1, "口数", 1, 4), (2, None, 0, 0), (3, None, 0, 0)}
    assert I.averages(own, ["body"]).first()["n"] == 3
    assert R.corpus_index(save([(1, "other")])) is not own


def test_source_diverse_equals_the_whole_ranking(spark):
    rng = np.random.default_rng(4)
    rows = [(int(q), f"d{rng.integers(0, 9)}", pos, float(rng.integers(1, 12))) for q in range(4) for pos in range(int(rng.integers(0, 60)))]
    df = spark.createDataFrame(rows, "query_id bigint, document_id string, pos bigint, score double")
    got = {(r["query_id"], r["rank"]): r["pos"] for r in R.source_diverse(df, 2, 5).collect()}
    for q in range(4):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[2]))
        seen, first, rest = {r[1] for r in own[:2]}, [], []
        for r in own[2:]:
            (rest if r[1] in seen else first).append(r)
            seen.add(r[1])
        want = [r[2] for r in (own[:2] + first + rest)[:5]]
        assert [got[(q, k + 1)] for k in range(len(want))] == want


def test_budget_and_signals(spark):
    fold = runs.BudgetFold({"duration_ms": 100, "calls": 2, "tokens": 5}, observed=frozenset({"tokens"}))
    assert fold.preview({"calls": 1}, 100) == "duration_ms" and fold.preview({"calls": 9, "tokens": 1}) == "tokens" and fold.preview({"calls": 3}) == "calls" and fold.preview({"calls": 2}, 99) is None
    assert fold.apply(1, "reserve", "r", {"calls": 1}, 120)["refused_on"] == "duration_ms"
    rows = [("r", 1, "s", "o", None, None, "SUCCESS", {"output_hash": "A" * 64, "artifact_count": "3"}, {"artifact_count": "4", "evidence_count": "-1"}), ("r", 2, "s", "o", None, "E", "FAILED", None, {"output_hash": "zz"})]
    df = spark.createDataFrame(rows, "run_id string, sequence bigint, stage string, operation string, tool_name string, error_code string, status string, input_summary map<string,string>, output_summary map<string,string>")
    got = runs.progress_signals(df).orderBy("sequence").collect()
    assert (got[0]["output_hash"], got[0]["artifact_count"], got[0]["evidence_count"], got[0]["successful"]) == ("a" * 64, 4, None, True)
    assert (got[1]["output_hash"], got[1]["artifact_count"], got[1]["successful"]) == (None, None, False)


def test_files(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "at bigint, v array<float>")
    files.write_npy(vectors, f"file://{tmp_path}/v", "at", "v")
    read = np.concatenate([np.load(p) for p in sorted((tmp_path / "v").glob("*.npy"))])
    assert read.shape == (50, 2) and (read[:, 0] == np.arange(50)).all()
    (tmp_path / "a").write_bytes(b"x\r\ny")
    (tmp_path / "b").write_bytes(b"x\ny")
    named = files.content_fingerprint(spark, {"one": f"file://{tmp_path}/a", "two": f"file://{tmp_path}/b"})
    assert named["one"] == named["two"] and len(named["fingerprint"]) == 64
    assert files.content_fingerprint(spark, {"none": f"file://{tmp_path}/none"})["fingerprint"] == "unknown"
    assert files.svg_text(b"<svg xmlns='http://www.w3.org/2000/svg'><title> a  b</title><text>c<tspan>d</tspan></text></svg>") == "a b\ncd"
    with pytest.raises(ValueError):
        files.svg_text(b"<!DOCTYPE svg><svg/>")
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "i int, t string")
    a, b = df.select(hashed_vector("t").alias("v")).collect(), df.select(hashed_vectors("t").alias("v")).collect()
    assert a == b and b[1]["v"] is None


def test_release_removes_intermediate_tables(spark):
    from strataforge.plans import tables

    df = tables.written(spark.range(3).toDF("x"))
    assert df.count() == 3 and tables.release(spark) >= 1 and tables.release(spark) == 0


def test_compound_aliases(spark):
    known = {"zone", "blend", "zone-blend", "re", "try", "a-b"}
    assert R.aliased(["zone", "blend", "the", "re-try", "x-y", "zone-blend"], known) == ["zone-blend", "the", "re", "try", "x-y", "zone-blend"]
    assert R.aliased([], known) == [] and R.aliased(["zone", "the"], known) == ["zone", "the"]
    queries = spark.createDataFrame([(1, "Zone blend re-try x-y"), (2, ""), (3, None)], "query_id int, query string")
    postings = spark.createDataFrame([(t,) for t in sorted(known)], "term string")
    assert {r["query_id"]: r["aliased"] for r in R.compound_aliases(queries, postings).collect()} == {1: "zone-blend re try x-y", 2: "", 3: ""}
    with pytest.raises(ValueError):
        E.profile_matches(queries, "query", [("a", "x"), ("a", "y")])
