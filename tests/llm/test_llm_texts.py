"""Canonical forms, pieces and sentences: pure functions against hand-made cases, operators against odd tables."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataforge.llm import canonical as C
from strataforge.llm import pieces as P
from strataforge.llm import sentences as S

SAME = [
    ("café", "café"), ("model", "mоdel"), ("Set x", "Sеt x"), ("Set x", "Set　x"), ("abc12", "ａｂｃ１２"), ("file", "ﬁle"),
    ("a​b", "ab"), ("so­ft", "soft"), ("re-id", "re‑id"), ("人口", "⼈口"), ("версия", "вeрcия"), ("ab", "a﻿⁠b"),
    ("öl", "ӧl"), ("TOP", "ΤΟΡ"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("x2", "x²"), ("1", "①"), ("1/2", "½"), ("ab", "a b"), ("a b", "a  b"), ("a b", "a\nb"), ("a,b", "a，b"), ("word", "ward"), ("-", "—")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert C.canonical(a) == C.canonical(b)
    assert C.canonical(C.canonical(a)) == C.canonical(a)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_look(a, b):
    assert C.canonical(a) != C.canonical(b)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeopcxyABEаеорсивο​  ａ́", max_size=24))
def test_canonical_is_a_fixed_point_and_blind_to_look_alikes(text):
    once = C.canonical(text)
    assert C.canonical(once) == once
    table = str.maketrans({"a": "а", "e": "е", "o": "ο", "p": "р", "c": "с"})
    assert C.canonical(text.translate(table)) == once


def test_automaton_finds_within_its_bound():
    trie = C.Trie(["версия", "model"])
    assert trie.nearest("вep​cия") == "версия"
    assert trie.nearest("modal") is None
    assert trie.nearest("modal", bound=1) == "model"
    assert trie.nearest("mdel", bound=1) == "model"
    assert trie.nearest("moddel", bound=1) == "model"


def test_form_without_the_vocabulary_file(tmp_path):
    empty = tmp_path / "none.tiktoken"
    empty.write_bytes(b"")
    assert C.canonical("вeрcия", str(empty)) == "версия"


def test_look_alike_pairs_against_brute_force(spark):
    texts = [a for pair in SAME + DIFFERENT for a in pair] + ["dup", "dup", "d​up", None, ""]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, text string, form string")
    found = {tuple(r) for r in C.look_alike_pairs(df, "id", "text").collect()}
    wanted = {(i, j) for i, a, _ in rows for j, b, _ in rows if i < j and a is not None and b is not None and a != b and C.canonical(a) == C.canonical(b)}
    assert found == wanted
    assert C.look_alike_pairs(df.limit(0), "id", "text").count() == 0
    assert C.with_canonical(df, "text", "form").where("text is null and form is null").count() == 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab.\n ,。#", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_pieces_keep_the_text(text, limit, overlap):
    found = P.cut(text, limit, overlap) if text else []
    assert "".join(text[own:end] for _, own, end in found) == text
    for (back, own, end), before in zip(found, [None, *found]):
        assert end - back <= limit and own - back <= overlap and back <= own
        if before:
            assert before[1] <= back


def test_pieces_cut_at_boundaries_and_carry_headings(spark):
    body = "# Top\n" + "A sentence here. " * 60 + "\n## Inner\n" + "More words stand here. " * 60
    rows = [(1, body, ["Guide"]), (2, "short", ["x"]), (3, None, None), (4, "x" * 3000, None), (5, "y" * 1250, None)]
    df = spark.createDataFrame(rows, "pos bigint, text string, path array<string>")
    found = P.cut_oversized(df, "pos", "text", "path").orderBy("id", "piece_no").collect()
    assert {r["id"] for r in found} == {1, 4}
    for r in found:
        assert len(r["piece"]) <= 1250
    one = [r for r in found if r["id"] == 1]
    assert one[0]["heading_path"] == ["Guide", "Top"] and one[-1]["heading_path"] == ["Guide", "Top", "Inner"]
    assert all(r["piece"].rstrip()[-1] in ".p" or r["piece"].endswith("Inner\n") for r in one)
    assert "".join(r["piece"][r["overlap"] :] for r in found if r["id"] == 4) == "x" * 3000
    assert P.cut_oversized(df.limit(0), "pos", "text", "path").count() == 0
    with pytest.raises(ValueError):
        P.cut_oversized(df, "pos", "text", "path", 100, 100)


UNITS = [
    ("# Head v1.2\nIt ends. It goes on", ["# Head v1.2", "It ends.", "It goes on"]),
    ("Ends at 5 p.m. The next. See No. 4 and fig. 2 of App. B here. Done", ["Ends at 5 p.m.", "The next.", "See No. 4 and fig. 2 of App. B here.", "Done"]),
    ("Well... it works. Is it 3.14?! Yes", ["Well... it works.", "Is it 3.14?!", "Yes"]),
    ("It prints \"One. Two.\" before exit. Next", ["It prints \"One. Two.\" before exit.", "Next"]),
    ("It said, “Stop!” Then it ran (it did. Really.) and fell.", ["It said, “Stop!”", "Then it ran (it did. Really.) and fell."]),
    ("他说：“走！”她走了。日志写“丢失。重启”，然后退出。唉……又错了！", ["他说：“走！”", "她走了。", "日志写“丢失。重启”，然后退出。", "唉……又错了！"]),
    ("Am 28. März fehlten 5 Ränder! Die 9. Stufe, d. h. Masken, bleibt aus. Los 84. Der Rest", ["Am 28. März fehlten 5 Ränder!", "Die 9. Stufe, d. h. Masken, bleibt aus.", "Los 84.", "Der Rest"]),
    ("Er meldet „Aus. Ende.“ und geht. Gut", ["Er meldet „Aus. Ende.“ und geht.", "Gut"]),
    ("सही है । नया", ["सही है ।", "नया"]),
    ("กขค งจv1.2ฉ", ["กขค", "งจv1.2ฉ"]),
    ("an \"open quote ends. here\nnext", ["an \"open quote ends.", "here", "next"]),
    ("  \n　\n", []), ("", []), ("conf.d/x.bak stays. ok", ["conf.d/x.bak stays.", "ok"]),
]


@pytest.mark.parametrize("text,wanted", UNITS)
def test_units(text, wanted):
    assert [text[a:b] for a, b in S.units([text])[0]] == wanted


def test_chunked_scan_equals_one_run():
    rng = random.Random(3)
    streams = [[rng.randrange(1, S.SYMBOLS) for _ in range(rng.choice((0, 5, 40, 700)))] for _ in range(12)]
    step, ends = S.tables(max(S.nesting(streams)))
    for chunk in (1, 7, 64):
        for got, stream in zip(S.run_transducer(streams, chunk), streams):
            state, wanted = 0, []
            for s in stream:
                wanted.append(bool(ends[s, state]))
                state = int(step[s, state])
            assert got.tolist() == wanted


def test_sentences_operator(spark):
    rows = [(1, "One. Two.", "x"), (2, None, "x"), (3, "", "x"), (4, "A (b. " * 3000 + "end)", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string")
    found = S.sentences(df, "doc_id", "text").collect()
    assert [(r["sentence_no"], r["sentence"]) for r in found if r["id"] == 1] == [(1, "One."), (2, "Two.")]
    assert {r["id"] for r in found} == {1, 4}
    assert S.sentences(df.limit(0), "doc_id", "text").count() == 0


def test_characters_that_show_nothing_change_no_form():
    from strataforge.llm.canonical import canonical as form

    for code in [*range(0x20, 0x3000), *range(0xF900, 0x10000)]:
        assert form(f"a{chr(code)}b") == form(f"a{chr(code)}b\u200b"), hex(code)
    assert form("r\u0133k") == "rijk"
    for letter in "กກཀ":
        assert form(letter + "\u200d" + letter) == letter * 2
    assert form("क\u200dष") != form("कष")


def test_nesting_has_no_bound_and_lines_are_read_once():
    import random
    import time

    from strataforge.llm import sentences

    def cut(text):
        return [text[a:b] for a, b in sentences.units([text])[0]]

    assert cut("Alpha (beta (gamma (delta (eps one. Fox) golf two. Hotel) india three. Juliet) kilo four. Lima) mike. Next one.") == [
        "Alpha (beta (gamma (delta (eps one. Fox) golf two. Hotel) india three. Juliet) kilo four. Lima) mike.", "Next one.",
    ]
    assert cut("«Beta «gamma one.» delta two. Echo». Next.") == ["«Beta «gamma one.» delta two. Echo».", "Next."]
    assert cut("«Alpha «beta» gamma. Delta») end. Next.") == ["«Alpha «beta» gamma. Delta») end.", "Next."]
    assert cut("Open «alpha «beta» gamma. Delta.") == ["Open «alpha «beta» gamma.", "Delta."]
    deep = "(" * 5000 + "a. B" + ")" * 5000 + " end. Next."
    assert cut(deep) == [deep[:-6], "Next."]
    rng = random.Random(3)
    streams = [[rng.choice(range(1, sentences.SYMBOLS)) for _ in range(rng.randrange(700))] for _ in range(60)]
    for stream, got in zip(streams, sentences.run_transducer(streams, 16)):
        assert (sentences.run_counter(stream) == got).all()
    for text in ("ก ข" * 330_000, "am 3. Mai " * 50_000):
        began = time.time()
        sentences.units([text])
        assert time.time() - began < 8


def test_the_trie_decides_where_the_table_can_not(tmp_path):
    import base64

    from strataforge.llm import canonical as C

    ranks = tmp_path / "words.tiktoken"
    # Two letters drawn like Y: the table takes the first, the vocabulary knows the word.
    ranks.write_bytes(b"\n".join(base64.b64encode(w.encode()) + b" %d" % i for i, w in enumerate([" ҮНДЭС", "paypal", "cop", "сор"])))
    empty = tmp_path / "none.tiktoken"
    empty.write_bytes(b"")
    for stored in ("ҮНДЭС", "УНДЭС", "Ү\u200bНДЭС", "УНДЭC", "YНДЭС"):
        assert C.canonical(stored, str(ranks)) == "ҮНДЭС"
        assert C.canonical(stored, str(empty)) == "УНДЭС"
    assert C.canonical("рауpal", str(ranks)) == C.canonical("ｐay\u200dpal", str(ranks)) == "paypal"
    assert C.canonical("сор", str(ranks)) == "cop"
    trie = C.Trie(["paypal", "ҮНДЭС"])
    assert trie.nearest("раураl") == "paypal" and trie.nearest("paypol") is None and trie.nearest("paypol", 1) == trie.nearest("paypa", 1) == trie.nearest("paaypal", 1) == "paypal"
    with pytest.raises(FileNotFoundError):
        C.canonical("рауpal", str(tmp_path / "missing"))


def test_random_looks_come_to_one_form():
    import random
    import unicodedata

    from strataforge.llm import canonical as C

    rng = random.Random(11)
    alike = {k: v[1:] for k, v in C.DRAWN_LIKE.items()}
    plain = ["network", "Проект", "данные", "résumé", "ценa", "Ήλιος", "COPY", "x", "où", "Straße", "fix", "ΑΒΓ", "мир", "Über"]
    for _ in range(400):
        words = rng.choices(plain, k=rng.randrange(1, 6))
        text = " ".join(words)
        other = []
        for c in text:
            if c in alike and rng.random() < 0.4:
                c = rng.choice(alike[c])
            elif c.isascii() and c.isalnum() and rng.random() < 0.3:
                c = chr(ord(c) + 0xFEE0)
            elif c == " " and rng.random() < 0.5:
                c = rng.choice("\u00a0\u2003\u3000")
            elif rng.random() < 0.3:
                c = unicodedata.normalize("NFD", c)
            other.append(c + rng.choice(["", "", "\u200b", "\u2060", "\u00ad"]))
        assert C.canonical("".join(other)) == C.canonical(text)
        again = C.canonical(text)
        assert C.canonical(again) == again
    forms = {C.canonical(w) for w in plain}
    assert len(forms) == len(set(map(C.look, plain)))
    every = [chr(c) for c in range(0x20, 0x3100) if c != 13 and unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    bad = [c for c in every if C.canonical("a" + c + "b") != C.canonical("a" + c + "b\u200b")]
    assert not bad, bad[:20]


def test_classes_of_look_alikes(spark):
    from strataforge.llm import canonical as C

    rows = [(1, "paypal"), (2, "рaypal"), (3, "paypal"), (4, "pаypаl"), (5, "other"), (6, None), (None, "рaypal"), (7, "other")]
    df = spark.createDataFrame(rows, "pos bigint, content string")
    got = sorted(tuple(r) for r in C.look_alike_classes(df, "pos", "content").collect())
    assert got == [(1, 1, 1, 4, 3), (1, 2, 2, 4, 3), (1, 3, 1, 4, 3), (1, 4, 4, 4, 3)]
    assert C.look_alike_classes(df.limit(0), "pos", "content").count() == 0
