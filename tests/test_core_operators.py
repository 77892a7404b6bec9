"""Core operators against brute force and hand-made rows, with nulls, ties, repeats, empty tables and clashing names."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strataforge.functions import rules
from strataforge.functions.text import tokens_of, tokens
from strataforge.functions.unicode import squeezed
from strataforge.operators import lifecycle as L
from strataforge.operators import metrics as M
from strataforge.operators import retrieval as R
from strataforge.operators import snapshots
from strataforge.operators.components import connected_components
from strataforge.operators.ordering import running_total

T0 = datetime(2025, 1, 1)


def _components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {(x, root(x)) for x in list(parent)}


@pytest.mark.parametrize("merge_rows", [1_000_000, 3])
def test_components_in_memory_and_by_star_rounds(spark, merge_rows):
    rng = random.Random(merge_rows)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200, i) for i in range(201, 240)] + [(i, i + 1) for i in range(300, 330)] + [(5, None), (None, 3), (7, 7)] * 2
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    assert {tuple(r) for r in connected_components(df, merge_rows=merge_rows).collect()} == _components(edges)
    assert connected_components(df.limit(0), merge_rows=merge_rows).count() == 0


@pytest.mark.parametrize("by", [None, "k"])
def test_running_total(spark, by):
    rng = random.Random(8)
    rows = [(rng.choice("abc"), i, rng.choice([None, rng.randrange(50)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at bigint, v bigint, extra bigint").repartition(7)
    got = {r["at"]: r["upto"] for r in running_total(df, ["at"], "v", "upto", by=by).collect()}
    sums = {}
    for k, at, v, _ in rows:
        key = k if by else None
        sums[key] = sums.get(key, 0) + (v or 0)
        assert got[at] == sums[key]
    assert running_total(df.limit(0), ["at"], "v", "upto", by=by).count() == 0


def test_snapshot_changes_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for project in ("p", "q"):
        items = {f"R-{i}": f"text {i}" for i in range(150)}
        for no in (1, 2, 4, 5):
            for k in rng.sample(sorted(items), 12):
                items[k] = rng.choice([None, items[k], f"new {rng.random()}", f" {items[k]}\n"])
            for k in rng.sample(sorted(items), 5):
                del items[k]
            items[f"R-{1000 * no}"] = "fresh"
            for k, v in items.items():
                spelled = rng.choice([k, k.lower(), f" {k} "])
                rows.append((project, no, spelled, v, T0 + timedelta(days=no), f"{k}{no}", "x"))
                if rng.random() < 0.1:
                    rows.append((project, no, k, "late", T0 + timedelta(days=no, hours=1), f"{k}{no}late", "x"))
    rows += [("p", None, "R-1", "x", T0, "n", "x"), (None, 1, "R-1", "x", T0, "n", "x"), ("p", 1, None, "x", T0, "n", "x"), ("one", 1, "R-1", "x", T0, "n", "x")]
    df = spark.createDataFrame(rows, "project string, no int, ident string, content string, at timestamp, item string, key string")
    names = ("project", "no", "ident", "content", "at", "item")
    latest = {}
    for p, n, k, c, at, _, _ in rows:
        if None in (p, n, k):
            continue
        key = (p, n, k.strip().lower())
        if key not in latest or at > latest[key][0]:
            latest[key] = (at, squeezed(c) if c is not None else None)
    wanted = set()
    for p in {k[0] for k in latest}:
        nos = sorted({k[1] for k in latest if k[0] == p})
        for a, b in zip(nos, nos[1:]):
            old, new = ({k[2]: v[1] for k, v in latest.items() if k[:2] == (p, n)} for n in (a, b))
            for k in old.keys() | new.keys():
                kind = "ADDED" if k not in old else "REMOVED" if k not in new else "MODIFIED" if old[k] != new[k] else None
                if kind:
                    wanted.add((p, k, a, b, kind))
    changes = snapshots.snapshot_changes(df, *names, mean=8)
    assert {tuple(r)[:5] for r in changes.collect()} == wanted
    full = snapshots.with_contents(changes, df, *names).collect()
    assert len(full) == len(wanted)
    for r in full:
        assert (r["old_content"] is None) or r["change_type"] != "ADDED"
        if r["change_type"] == "MODIFIED":
            sides = [squeezed(x) if x is not None else None for x in (r["old_content"], r["new_content"])]
            assert sides[0] != sides[1]
    assert snapshots.snapshot_changes(df.limit(0), *names).count() == 0


def test_tokens_of_both_kinds(spark):
    text = "Straße v2.5.0 a_b-c 人口数 字1 élève"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(tokens(F.col("t")).alias("x")).collect()
    assert got[0]["x"] == ["strasse", "v2.5.0", "a_b-c", "人口", "口数", "字", "1", "l", "ve"] == tokens_of(text)
    assert got[1]["x"] == [] and got[2]["x"] == []


def _chunks(spark, rows):
    return spark.createDataFrame(rows, "pos bigint, document_id string, language string, version string, document_title string, heading_path array<string>, content string")


def test_fielded_ranking_prefers_headings(spark):
    chunks = _chunks(spark, [(1, "a", "en", "v", None, ["Missed Fire Policy"], "Default: CONTINUE"), (2, "b", "en", "v", None, [], "missed fire policy " * 20), (3, "c", None, None, None, None, None)])
    queries = spark.createDataFrame([(1, "missed fire policy"), (2, None), (3, "unknown")], "query_id bigint, query string")
    assert [r["pos"] for r in R.top_hits(R.bm25(chunks, queries), chunks, 5).orderBy("rank").collect()] == [2]
    assert [r["pos"] for r in R.top_hits(R.bm25_fields(chunks, queries), chunks, 5).orderBy("rank").collect()] == [1, 2]


def test_source_diversity_orders(spark):
    hits = spark.createDataFrame([(1, i, d, float(10 - i), i) for i, d in enumerate("aaabc", 1)], "query_id int, pos int, document_id string, score double, rank int")
    order = lambda prefix, k: [r["pos"] for r in R.source_diverse(hits, prefix, k).orderBy("rank").collect()]
    assert order(0, 3) == [1, 4, 5] and order(2, 4) == [1, 2, 4, 5] and order(3, 5) == [1, 2, 3, 4, 5]
    capped = [r["pos"] for r in R.capped_per_document(hits, 1, 5).orderBy("rank").collect()]
    assert capped == [1, 4, 5]


def test_fusion_sums_and_breaks_ties_by_position(spark):
    lists = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 2, 2), (1, 1, 2, 1), (1, 1, 3, 2)], "query_id int, list_id int, pos int, rank int")
    got = R.fused(lists, 5, rrf_k=10).orderBy("rank").collect()
    assert [r["pos"] for r in got] == [2, 1, 3] and abs(got[0]["rrf"] - (1 / 11 + 1 / 12)) < 1e-9 and got[0]["lists"] == "0,1"


def test_facets(spark):
    df = spark.createDataFrame([("甲；；乙",), ("1) a; b\nc; d; e",), ("single",)], "q string")
    assert [r[0] for r in df.select(R.facets(F.col("q"))).collect()] == [["甲", "乙"], ["a", "b", "c", "d；e"], ["single"]]


def test_diff_and_versions(spark):
    old = spark.createDataFrame([("023", "500"), ("024", "x"), ("099", None), ("100", None)], "k string, v string")
    new = spark.createDataFrame([("023", "1000"), ("024", "x"), ("025", "y"), ("100", None)], "k string, v string")
    diff = L.keyed_diff(old, new, ["k"], "v")
    assert {(r["k"], r["change_type"]) for r in diff.collect()} == {("023", "MODIFIED"), ("024", "UNCHANGED"), ("099", "REMOVED"), ("025", "ADDED"), ("100", "UNCHANGED")}
    rows = spark.createDataFrame([("d", "1", "x"), ("d", "2", "x"), ("d", "3", "y"), ("d", "3", "x"), ("e", "1", None)], "d string, v string, h string")
    assert {tuple(r) for r in L.differing_versions(rows, ["d"], "v", "h").collect()} == {("d", "1", "3"), ("d", "2", "3")}


def test_impacts(spark):
    changed = spark.createDataFrame([("REQ",)], "item string")
    links, hints = spark.createDataFrame([("REQ", "DES")], "item string, target string"), spark.createDataFrame([("REQ", "DES"), ("REQ", "OPS"), ("REQ", "REQ")], "item string, target string")
    got = {(r["target"], r["provenance"]) for r in L.impacts(changed, links, hints).collect()}
    assert got == {("DES", "EXPLICIT"), ("OPS", "RETRIEVAL_SUGGESTION")}


def test_metric_conventions(spark):
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (2, 1, "a"), (2, 2, "a"), (2, 3, "b")], "query_id int, rank int, source string")
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "query_id int, source string")
    once = {r["query_id"]: r for r in M.per_query(hits, truth).collect()}
    assert once[1]["rr"] == 0.5 and once[2]["rr"] == 1.0 and once[2]["recall"] == 1.0
    distinct = {r["query_id"]: r for r in M.per_query(hits, truth, ndcg="distinct").collect()}
    summed = {r["query_id"]: r for r in M.per_query(hits, truth, mrr="sum").collect()}
    assert abs(distinct[2]["ndcg"] - 1.0) < 1e-9 and abs(summed[2]["rr"] - (1 + 1 / 3) / 2) < 1e-9
    whole = M.summary(M.per_query(hits, truth)).first()
    assert whole["hit_at_1"] == 0.5 and whole["mrr"] == 0.75
    lat = spark.createDataFrame([(float(v),) for v in (10, 30, 50)], "v double").withColumn("g", F.lit(1))
    r = M.sample_stats(lat, ["g"], "v").first()
    assert (r["p50"], r["p95"], r["p95_nearest"]) == (30.0, 48.0, 50.0)


def test_rules(spark):
    url = lambda u: spark.createDataFrame([(u,)], "u string").select(rules.canonical_url(F.col("u"))).first()[0]
    assert url("HTTPS://Docs.Example:443/a/?b=2&a=1#x") == "https://docs.example/a?a=1&b=2"
    assert url("http://h:8080") == "http://h:8080/" and url("ftp://h/x") is None
    text = spark.createDataFrame([("api_key = abc123, Bearer xyz sk-12345678ab ok",)], "t string")
    assert text.select(rules.redacted(F.col("t"))).first()[0] == "api_key = [REDACTED], Bearer [REDACTED] [REDACTED] ok"
    assert rules.hashed_vector_of("").sum() == 0 and abs((rules.hashed_vector_of("Ab c") ** 2).sum() - 1) < 1e-6
    kinds = {"x": ["set", "阈值"], "y": ["setting"]}
    got = [r[0] for r in spark.createDataFrame([("Set it",), ("settings",), ("调阈值 setting",), (None,)], "t string").select(rules.keyword_class(F.col("t"), kinds)).collect()]
    assert got == ["x", "general", "x", "general"]


def test_dense_leg_finds_chunks_without_a_shared_token(spark, tmp_path):
    import numpy as np

    from strataforge.operators import queries_retrieval as Q

    rng = random.Random(6)
    contents = [" ".join(rng.choices(["alpha", "beta", "gamma", "版本升级", "delta"], k=rng.randrange(1, 9))) for _ in range(60)] + ["configurations", "", None, "x"]
    rows = [(i, "en", "v1", "d", "k", "t", ["h"], c) for i, c in enumerate(contents)]
    spark.createDataFrame(rows, "pos bigint, language string, version string, document_id string, document_key string, document_title string, heading_path array<string>, content string").write.parquet(f"{tmp_path}/chunks.parquet")
    asked = {0: "configuration alpha", 100: "版本", 200: None, 300: "gamma"}
    spark.createDataFrame([(i, q) for i, q in asked.items()] + [(7, "alpha")], "pos bigint, query string").write.parquet(f"{tmp_path}/cases.parquet")
    vectors = {i: rules.hashed_vector_of(c).astype(float) for i, c in enumerate(contents) if c is not None}
    score = {(q, i): round(float(rules.hashed_vector_of(t).astype(float) @ v), 6) for q, t in asked.items() if t for i, v in vectors.items()}
    best = {q: sorted(vectors, key=lambda i: (-score[q, i], i)) for q, t in asked.items() if t}
    texts = [c for c in contents if c is not None]
    assert (rules.hashed_matrix(texts, {}) == np.array([rules.hashed_vector_of(c) for c in texts])).all()
    chunks, queries = Q._chunks(spark, str(tmp_path)), Q._queries(spark, str(tmp_path))
    hits = R.hashed_hits(chunks, queries, 20).collect()
    assert {(r["query_id"], r["rank"]): (r["pos"], r["score"]) for r in hits} == {(q, k + 1): (i, pytest.approx(score[q, i], abs=2e-6)) for q in best for k, i in enumerate(best[q][:20])}
    bm = {}
    for r in R.ranked(R.bm25(chunks, queries), [F.desc("score"), F.asc("pos")], 100).collect():
        bm.setdefault(r["query_id"], {})[r["pos"]] = r["rank"]
    for name, w in (("dense_hybrid_rrf", (1, 1)), ("dense_weighted_rrf", (0.7, 0.3))):
        wanted = set()
        for q in best:
            total = {}
            for weight, ranks in ((w[0], {i: k + 1 for k, i in enumerate(best[q][:50])}), (w[1], {i: k for i, k in bm.get(q, {}).items() if k <= 50})):
                for i, k in ranks.items():
                    total[i] = total.get(i, 0) + weight / (60 + k)
            wanted |= {(q, i, k + 1) for k, i in enumerate(sorted(total, key=lambda i: (-round(total[i], 9), i))[:5])}
        assert {(r["query_id"], r["pos"], r["rank"]) for r in Q.QUERIES[name](spark, str(tmp_path)).collect()} == wanted
    assert 60 in best[0][:5] and 60 not in bm[0]
    again = {(r["query_id"], r["pos"], r["rank"]) for r in Q.dense_pool_rerank(spark, str(tmp_path)).collect()}
    assert again == {(q, i, k + 1) for q in best for k, i in enumerate([i for i in best[q] if i in bm.get(q, {})][:5])}


def test_diffs_cover_all_existing_steps(spark, tmp_path):
    from strataforge.operators import queries_evidence, queries_lifecycle, queries_metrics

    items = {1: {"a": "one", "b": "two"}, 3: {"a": "one", "b": "Three", "c": "x"}, 8: {"a": "one"}}
    rows = [(n, T0, f"{k}{n}", "p", f" {k.upper()} ", None if n == 3 else f"title {k}", text, f"s{n}", {"m": "1" if n < 8 else "2"}) for n, own in items.items() for k, text in own.items()]
    spark.createDataFrame(rows, "snapshot_no int, delivered_at timestamp, item_id string, project_id string, external_identifier string, title string, content string, version_id string, metadata map<string,string>").write.parquet(f"{tmp_path}/engineering_snapshots.parquet")
    spark.createDataFrame([("p", "B", "MODIFIED", "p-s3"), ("p", "b", "REMOVED", "p-s8"), ("p", "q", "ADDED", "p-s8")], "project_id string, external_identifier string, change_type string, new_version_id string").write.parquet(f"{tmp_path}/item_changes.parquet")
    chunks = [(i, f"doc:en:{k}", "d", f"{v}", c, T0) for i, (v, k, c) in enumerate([("v1.9.0", 1, "a"), ("v1.9.0", 2, "b"), ("v1.10.0", 1, "a"), ("v1.10.0", 2, "B"), ("v3.0.0", 1, "c")])]
    chunks = [(i, f"{c}:{v}", k, v, t, at) for i, c, k, v, t, at in chunks]
    df = spark.createDataFrame(chunks, "pos bigint, chunk_id string, document_key string, version string, content string, ingested_at timestamp")
    df = df.withColumn("chunk_id", F.concat(F.col("version"), F.lit(":en:"), F.split("chunk_id", ":")[2]))
    for name in ("document_id", "language", "heading", "repository", "license"):
        df = df.withColumn(name, F.lit("x"))
    df.withColumn("heading_path", F.array(F.lit("x"))).write.parquet(f"{tmp_path}/chunks.parquet")

    def rows_of(f):
        return {tuple(r) for r in f(spark, str(tmp_path)).collect()}

    assert rows_of(queries_lifecycle.item_diff) == {
        ("p", 1, 3, "a", "UNCHANGED"), ("p", 1, 3, "b", "MODIFIED"), ("p", 1, 3, "c", "ADDED"), ("p", 3, 8, "a", "UNCHANGED"), ("p", 3, 8, "b", "REMOVED"), ("p", 3, 8, "c", "REMOVED"),
    }
    assert rows_of(queries_lifecycle.append_only_extension) == {("p", 1, 3, 2), ("p", 3, 8, 3)}
    assert rows_of(queries_evidence.carried_titles) == {("p", 1, 3, "a", "title a", True), ("p", 1, 3, "b", None, False), ("p", 1, 3, "c", None, False), ("p", 3, 8, "a", "title a", False)}
    assert rows_of(queries_metrics.recorded_change_accuracy) == {("MODIFIED", "MODIFIED", 1), ("REMOVED", "REMOVED", 1), ("ADDED", "NONE", 1)}
    assert rows_of(queries_lifecycle.section_diff) == {
        ("d", "v1.9.0", "v1.10.0", "en", 1, "UNCHANGED"), ("d", "v1.9.0", "v1.10.0", "en", 2, "MODIFIED"), ("d", "v1.10.0", "v3.0.0", "en", 1, "MODIFIED"), ("d", "v1.10.0", "v3.0.0", "en", 2, "REMOVED"),
    }
    assert rows_of(queries_lifecycle.diff_summary) == {("d", "v1.9.0", "v1.10.0", 0, 0, 1, 1, 2), ("d", "v1.10.0", "v3.0.0", 0, 1, 1, 0, 2)}
