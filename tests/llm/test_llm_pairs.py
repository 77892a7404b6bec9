"""Near duplicates, overlaps, leakage, splits and mixing against brute force on small tables with nulls, ties and repeats."""

import random

import numpy as np
import pytest

from strataforge.llm import leakage, mixing, near_duplicates, overlaps, splits
from strataforge.llm.tokens import similarity, token_set
from strataforge.plans import tables

WORDS = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]


def _texts(seed, families, copies, length=40, edits=4):
    rng = random.Random(seed)
    out = []
    for _ in range(families):
        base = rng.sample(WORDS, length)
        out.append(" ".join(base))
        for _ in range(copies):
            other = list(base)
            for _ in range(rng.randrange(edits)):
                other[rng.randrange(length)] = rng.choice(WORDS)
            out.append(" ".join(other))
    return out


def _groups(texts, threshold, least):
    sets = {i: token_set(t) for i, t in texts if t is not None and i is not None}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and similarity(sets[i], sets[j]) >= threshold:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    members = {}
    for i in sets:
        members.setdefault(root(i), []).append(i)
    return {(min(m), i) for m in members.values() if len(m) > 1 for i in m}


def test_near_duplicates_against_brute_force(spark):
    texts = _texts(1, 30, 4) + ["few words"] * 3 + ["", "x " * 50] + _texts(2, 3, 0) * 3
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(900, None, "x"), (None, texts[0], "x")]
    df = spark.createDataFrame(rows, "pos bigint, text string, tokens string")
    found = {tuple(r) for r in near_duplicates.near_duplicate_groups(df, "pos", "text").collect()}
    assert found == _groups([(a, b) for a, b, _ in rows], 0.7, 20)
    assert near_duplicates.near_duplicate_groups(df.limit(0), "pos", "text").count() == 0


def test_texts_near_the_threshold_are_read_without_a_shuffle(spark, monkeypatch):
    made = []

    own = near_duplicates.written

    def kept(df, **how):
        made.append((df, own(df, **how)))
        return made[-1][1]

    monkeypatch.setattr(near_duplicates, "written", kept)
    texts = [" ".join(WORDS[at : at + 40]) for at in range(0, 360, 90)] + [" ".join(WORDS[at : at + 33] + WORDS[at + 40 : at + 47]) for at in range(0, 360, 90)]  # 33 of 47 are shared: 0.702
    texts += _texts(4, 20, 2, edits=2)
    rows = list(enumerate(texts))
    found = {tuple(r) for r in near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, "pos bigint, text string"), "pos", "text").collect()}
    assert found == _groups(rows, 0.7, 20)
    plan, wide = next(x for x in made if x[1].columns == ["id", "tokens"])
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert set(range(8)) <= {r[0] for r in wide.collect()} and wide.count() < len(rows) / 2
    assert {r[0]: np.frombuffer(r[1], np.uint64).tolist() for r in wide.collect()}[0] == sorted(near_duplicates.xxhash.xxh3_64_intdigest(t) for t in token_set(texts[0]))


def test_shuffles_of_a_written_table_are_removed_at_once(spark):
    import time
    from pathlib import Path

    def shuffles():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f.name.split("_")[1] for d in dirs for f in Path(d.getPath()).rglob("shuffle_*")}

    before, key = shuffles(), tables._CLEANUP
    out = tables.written(spark.range(1000).repartition(3, "id"), drop_shuffles=True)
    for _ in range(40):
        if not (left := shuffles() - before):
            break
        time.sleep(0.25)
    assert not left and out.count() == 1000 and spark.conf.get(key, None) is None


def test_bands_of_a_text_depend_on_no_other(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 900, n, dtype=np.uint32)) for n in (20, 1, 400, 20, 77, 1, 90)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "tokens"])
    whole = pa.Table.from_batches(near_duplicates._band_pass(iter([batch]))).combine_chunks()
    monkeypatch.setattr(near_duplicates, "TOKENS", 120)
    assert [b.num_rows for b in near_duplicates._sliced(batch)] == [2, 1, 3, 1]
    assert pa.Table.from_batches(near_duplicates._band_pass(iter([batch]))).combine_chunks() == whole
    regs = near_duplicates.registers(np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1], 9)
    assert all((regs[i] == near_duplicates._values(s, 9).max(axis=0)).all() for i, s in enumerate(sets))


def test_hot_bucket_blocks_lose_no_link():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n, pairs = 700, near_duplicates._Buckets(0.7)
    base = [rng.integers(0, 2**63, 2, dtype=np.int64) for _ in range(6)]
    which = rng.integers(0, 6, n)
    s = np.array([base[k] for k in which])
    flips = rng.integers(0, 64, n)
    s[:, 0] ^= np.left_shift(np.int64(1), flips % 63)
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(n, 7)), pa.array(np.arange(n)), pa.array(np.full(n, 50, np.int32)), pa.array(s[:, 0]), pa.array(s[:, 1])], names=["key", "id", "n", "s1", "s2"])
    for size in (n, 97):
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        total = 0
        for out in pairs(iter([batch.slice(i, size) for i in range(0, n, size)])):
            for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                parent[root(a)] = root(b)
                total += 1
        assert len({root(i) for i in range(n)}) == len(set(which.tolist()))
        assert total < 20 * n


def test_hot_bucket_links_across_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(near_duplicates, "BLOCK", 50)
    rng = np.random.default_rng(8)
    pairs, rows = near_duplicates._Buckets(0.7), []
    far = near_duplicates.PARITIES - int(np.flatnonzero(pairs.keep)[0])
    for _ in range(60):
        # Two leaders out of reach, each with a member; only the members are near.
        flips = rng.permutation(128)
        bits = [(np.isin(np.arange(128), flips[:k])).astype(np.uint8) for k in (0, 10 + far, 5, 5 + far)]
        rows.append(rng.integers(0, 2, 128).astype(np.uint8) ^ np.array(bits))
    s = np.packbits(np.array(rows).transpose(1, 0, 2).reshape(-1, 128), axis=1).view(np.int64)
    count = len(s)

    def components(links):
        parent = list(range(count))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[root(a)] = root(b)
        return [min(j for j in range(count) if root(j) == r) for r in map(root, range(count))]

    near = [pairs.keep[pairs.agree((s[:, 0], s[:, 1]), (s[i, 0], s[i, 1]))] for i in range(count)]
    every = {(i, j) for i in range(count) for j in np.flatnonzero(near[i]).tolist() if i < j}
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(count, 7)), pa.array(np.arange(count)), pa.array(np.full(count, 50, np.int32)), pa.array(s[:, 0]), pa.array(s[:, 1])], names=["key", "id", "n", "s1", "s2"])
    for size in (count, 37, 97):
        got = {p for out in pairs(iter([batch.slice(i, size) for i in range(0, count, size)])) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
        assert got <= every and components(got) == components(every)


def test_registers_merge_and_estimate():
    a, b = np.arange(60, dtype=np.uint32), np.arange(20, 80, dtype=np.uint32)
    both = np.unique(np.concatenate([a, b]))
    regs = near_duplicates.registers(np.concatenate([a, b, both]), np.array([0, 60, 120]), 4096)
    assert (near_duplicates.merge(regs[0], regs[1]) == regs[2]).all()
    assert abs((regs[0] == regs[1]).mean() - 40 / 80) < 0.05
    assert near_duplicates.likely(0.7)[110:].all() and not near_duplicates.likely(0.7)[:80].any()


def test_cross_split_overlaps_against_brute_force(spark):
    rng = random.Random(4)
    texts = _texts(7, 40, 3, length=30, edits=5) + ["only five words stand here"] * 4 + ["only five words stand there"] * 2 + ["", None]
    rows = [(f"c{i}", t, rng.choice(["train", " Train", "DEV ", "holdout", None]), i, "clash") for i, t in enumerate(texts)]
    rows += [(rows[0][0], rows[0][1], rows[0][2], 10_000, "x")] + [(None, texts[0], "dev", 1, "x")]
    df = spark.createDataFrame(rows, "case_id string, summary string, split string, at int, text string")
    found = [tuple(r)[:2] for r in overlaps.cross_split_overlaps(df, "case_id", "summary", "split", "at").collect()]
    side = {i: (s or "").strip().lower() for i, _, s, _, _ in rows}
    own = {i: token_set(t) for i, t, _, _, _ in rows if t is not None}
    wanted = {(a, b) for a in own for b in own if a and b and side[a] == "train" and side[b] in ("dev", "holdout") and similarity(own[a], own[b]) >= 0.7}
    assert len(found) == len(set(found)) and set(found) == wanted
    assert overlaps.cross_split_overlaps(df.limit(0), "case_id", "summary", "split", "at").count() == 0


def test_cross_split_pairs_without_a_long_shared_span(spark):
    rng = random.Random(12)

    def spread(words, step):
        return [w if (i + 1) % step else f"new{rng.randrange(10**6)}" for i, w in enumerate(words)]

    pairs = [(WORDS[:35], spread(WORDS[:35], 12)), (WORDS[40:103], spread(WORDS[40:103], 10))]
    han = [chr(0x4E00 + i) for i in rng.sample(range(3000), 35)]
    pairs.append(("".join(han), "".join(chr(0x9000 + i) if i in (11, 23) else c for i, c in enumerate(han))))
    short = WORDS[120:140]
    pairs.append((short, short + short))
    for length in range(40, 91, 10):
        words = rng.sample(WORDS, length)
        parts = [words[i : i + 8] for i in range(0, length, 8)]
        pairs += [(words, spread(words, 9)), (words, sum(rng.sample(parts, len(parts)), [])), (words, [w for w in words for _ in range(2)])]
    rows = []
    for k, (a, b) in enumerate(pairs):
        rows += [(f"{side}{k}", x if isinstance(x, str) else " ".join(x), split, 1) for side, x, split in (("a", a, "train"), ("b", b, "dev"))]
    df = spark.createDataFrame(rows, "case_id string, summary string, split string, at int")
    found = {tuple(r)[:2] for r in overlaps.cross_split_overlaps(df, "case_id", "summary", "split", "at").collect()}
    own = {i: token_set(t) for i, t, _, _ in rows}
    wanted = {(a, b) for a in own for b in own if a[0] == "a" and b[0] == "b" and similarity(own[a], own[b]) >= 0.7}
    assert found == wanted and {(f"a{k}", f"b{k}") for k in range(len(pairs))} <= wanted


def test_every_pair_at_the_threshold_is_found(spark):
    """Random and even edits of texts of 34 to 200 tokens at similarities of 0.70 to 0.75: recall is whole."""
    rng, rows, wanted = random.Random(31), [], set()
    for n in (34, 60, 100, 200):
        for least in (0.70, 0.72, 0.75):
            edits = max(e for e in range(n) if (n - e) / (n + e) >= least)
            for even in (True, False):
                for _ in range(4):
                    base = [f"u{rng.randrange(10**7)}x" for _ in range(n - 10)] + WORDS[:10]
                    rng.shuffle(base)
                    at = {i * n // edits for i in range(edits)} if even else set(rng.sample(range(n), edits))
                    other = [f"v{rng.randrange(10**7)}y" if i in at else w for i, w in enumerate(base)]
                    k = len(rows)
                    rows += [(f"a{k}", " ".join(base), "train", 1), (f"b{k}", " ".join(other), "holdout", 1)]
                    wanted.add((f"a{k}", f"b{k}"))
    df = spark.createDataFrame(rows, "case_id string, summary string, split string, at int")
    found = {(r["id_a"], r["id_b"]): r for r in overlaps.cross_split_overlaps(df, "case_id", "summary", "split", "at").collect()}
    assert set(found) == wanted
    assert all(0.7 - 1e-9 <= r["similarity"] < 0.8 and r["cover_a"] == pytest.approx(r["cover_b"]) and r["longest"] >= 1 for r in found.values())


def test_hot_intervals_are_laid_out_as_cells(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "BLOCK", 7)
    rng = random.Random(6)
    rows = [(f"{'ab'[i % 2]}{i}", " ".join(WORDS[:12] + rng.sample(WORDS[12:18], 4)), ("train", "dev")[i % 2], 1) for i in range(120)]
    df = spark.createDataFrame(rows, "case_id string, summary string, split string, at int")
    found = [tuple(r)[:2] for r in overlaps.cross_split_overlaps(df, "case_id", "summary", "split", "at").collect()]
    own = {i: token_set(t) for i, t, _, _ in rows}
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in own for b in own if a[0] == "a" and b[0] == "b" and similarity(own[a], own[b]) >= 0.7}


def test_open_intervals_are_kept_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n = 300
    key, side = np.sort(rng.integers(0, 8, n)), rng.integers(0, 2, n)
    order = np.lexsort((side, key))
    key, side, zero = key[order], side[order], np.zeros(n, np.int64)
    cols = [key, zero, zero, side, zero, zero, zero, np.arange(n), zero + 10, zero, zero, zero, zero]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[str(k) for k in range(len(cols))])
    every = {(a, b) for a in range(n) for b in range(n) if side[a] == 0 and side[b] == 1 and key[a] == key[b]}
    for size in (n, 37, 1):
        out = overlaps.Intervals(0.7)(iter([batch.slice(i, size) for i in range(0, n, size)]))
        assert {p for x in out for p in zip(x.column(0).to_pylist(), x.column(1).to_pylist())} == every


def test_shared_spans():
    assert overlaps.shared_spans([1, 2, 3, 4, 9, 5], [7, 1, 2, 8, 3, 4, 5]) == [(0, 1, 2), (2, 4, 2), (5, 6, 1)]
    assert overlaps.shared_spans([1], [2]) == [] and overlaps.first_places(10, 0.7) == 4


def test_leaked_items_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS, k=25)), "en") for i in range(8)] + [(8, "人口" + "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60)), "zh"), (9, "too short", "en"), (10, None, "en"), (None, "x", "en")]
    docs = []
    for n in range(60):
        body = rng.choices(WORDS, k=rng.randrange(5, 80))
        if n % 3 == 0:
            item = items[rng.randrange(9)]
            if item[2] == "zh":
                body = [item[1][5 : 5 + rng.choice((31, 32, 40))]]
            else:
                w, k = item[1].split(), rng.choice((14, 15, 20))
                at = rng.randrange(len(w) - k)
                body[2:2] = [x.upper() + "," for x in w[at : at + k]]
        docs.append((n, " ".join(body), "clash"))
    docs += [(100, None, "x"), (101, "", "x"), (None, items[0][1], "x"), (102, items[0][1], "x"), (103, items[0][1], "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, minimum string")
    i = spark.createDataFrame(items, "item_id bigint, passage string, language string")
    found = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(d, i).collect()}
    wanted = {(a, b) for a, t, _ in docs for b, p, lang in items if None not in (a, t, b, p) and leakage.shared_run(leakage.words_of(t), leakage.words_of(p), lang == "zh")[0]}
    assert found == wanted and wanted
    assert leakage.leaked_items(d, i.limit(0)).count() == 0 and leakage.leaked_items(d.limit(0), i).count() == 0


def test_greedy_counts_replay_the_one_by_one_choice():
    rng = random.Random(2)
    for _ in range(60):
        sizes = {rng.randrange(1, 40): rng.randrange(1, 300) for _ in range(rng.randrange(1, 6))}
        targets = [("a", 0.7), ("b", 0.2), ("c", 0.1)]
        total = sum(s * m for s, m in sizes.items())
        short = [total * w for _, w in targets]
        for size in sorted(sizes, reverse=True):
            for _ in range(sizes[size]):
                k = max(range(3), key=lambda j: (short[j], -j))
                short[k] -= size
        got = splits.greedy_counts(list(sizes.items()), targets)
        assert all(sum(got[s]) == m for s, m in sizes.items())
        left = [total * w - sum(s * got[s][j] for s in sizes) for j, (_, w) in enumerate(targets)]
        assert sorted(round(x, 6) for x in left) == pytest.approx(sorted(round(x, 6) for x in short), abs=1e-6)


def test_splits_keep_groups_together(spark):
    rows = [(f"c{i:03}", f" Fam-{i % 37} " if i % 5 else None, f"c{i - 1:03}" if i % 11 == 0 and i else None, ["train", "Dev ", None][i % 3], "x") for i in range(300)]
    rows += [rows[4], ("c900", "", "missing", "train", "x"), (None, "fam_1", None, "dev", "x")]
    df = spark.createDataFrame(rows, "case_id string, family_id string, derived_from string, split string, root string")
    groups = splits.related_groups(df, "case_id", "family_id", "derived_from")
    placed = {r["id"]: (r["group_id"], r["split"]) for r in splits.assign_splits(groups, [("train", 0.7), ("dev", 0.15), ("holdout", 0.15)]).collect()}
    assert set(placed) == {r[0] for r in rows if r[0]}
    assert len({v for v in placed.values()}) == len({g for g, _ in placed.values()})
    for i in range(11, 300, 11):
        assert placed[f"c{i:03}"] == placed[f"c{i - 1:03}"]
    mixed = splits.conflicting_groups(df, groups, "case_id", "split").collect()
    assert mixed and all(placed[r["id"]][0] == r["group_id"] for r in mixed)
    none = splits.related_groups(df.limit(0), "case_id", "family_id", "derived_from")
    assert splits.assign_splits(none, [("train", 1.0)]).count() == 0


def test_mixture_reaches_shares(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 30))), rng.choice(["A-b", "a_b ", "c", "C", None, "zzz"]), "x") for i in range(600)] + [(700, "", "c", "x"), (701, None, "c", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens string")
    targets = spark.createDataFrame([("a_b", 0.8, 2), ("c", 0.15, 3), ("none", 0.05, 1)], "source string, target_share double, max_repeats int")
    drawn = mixing.mixture(df, targets, "doc_id", "text", "source")
    got = drawn.collect()
    assert len({(r["id"], r["repeat_no"]) for r in got}) == len(got)
    assert [r["finish"] for r in got] == sorted(r["finish"] for r in got)
    shares = {r["source"]: r["actual_share"] for r in mixing.reached_shares(drawn, targets).collect()}
    assert abs(shares["a_b"] - 0.8 / 0.95) < 0.02 and shares["none"] == 0
    assert max(r["repeat_no"] for r in got) <= 3
    whole = mixing.mixture(df, targets, "doc_id", "text", "source", budget=10**9).collect()
    assert sum(r["source"] == "c" for r in whole) == 3 * sum(r[2] in ("c", "C") and r[1] is not None for r in rows)
    assert mixing.mixture(df.limit(0), targets, "doc_id", "text", "source").count() == 0
