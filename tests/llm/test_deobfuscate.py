import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkveil.llm import deobfuscate as d


def plain(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], d.KINDS.index(s[0])))


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="@@..a1290 +(2)-é", max_size=60))
def test_plain_patterns(text):
    assert d.detect(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0459 -", min_size=14, max_size=40))
def test_cards(text):
    assert d.detect(text) == plain(text)


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail bob (at) example (dot) com now", "email", "bob (at) example (dot) com"),
        ("bob.smith at mail dot example dot org.", "email", "bob.smith at mail dot example dot org"),
        ("x [at] y.com", "email", "x [at] y.com"),
        ("аdmin@ехample.com", "email", "аdmin@ехample.com"),
        ("ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("call +1 four one five five five five one two three four ok", "phone", "+1 four one five five five five one two three four"),
        ("bo\u200bb@exam\u200bple.com", "email", "bo\u200bb@exam\u200bple.com"),
        ("😀 card 4111 1111 1111 １１１１ end", "card", "4111 1111 1111 １１１１"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    base, added = d.find(text)
    assert (kind, source) in [(k, text[a:b]) for k, a, b in added]
    assert source not in d.mask(text, base + added)


@pytest.mark.parametrize("text", ["look at the dot on the map", "one two", "meet me at noon", "seven of nine", "", "a @ b", "The (dot) product at (at) last"])
def test_clean_text_stays_clean(text):
    assert d.find(text) == ([], [])


def test_long_runs_are_linear():
    assert d.find("a" * 400_000 + "@") == ([], [])
    assert d.find("1" * 400_000) == ([], [])
    assert d.find("+" + "1(" * 200_000) == ([], [])


def test_frame(spark):
    rows = [(1, "a@b.co", "s"), (1, "a@b.co", "s"), (2, None, None), (None, "", "t"), (3, "x (at) y.org", "u")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    out = d.deobfuscate(df, masked="text").collect()
    assert len(out) == 5
    got = {r["doc_id"]: r for r in out}
    assert got[1]["text"] == "[EMAIL]" and got[1]["spans"][0].asDict() == {"kind": "email", "start": 0, "end": 6, "base": True}
    assert got[2]["text"] is None and got[2]["spans"] == [] and got[None]["text"] == ""
    assert got[3]["text"] == "[EMAIL]" and not got[3]["spans"][0]["base"]
    assert d.deobfuscate(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("ask jane (at) example dot com today", "email", "jane (at) example dot com"),
        ("ask jane@example dot com today", "email", "jane@example dot com"),
        ("ask jane at example dot xyz today", "email", "jane at example dot xyz"),
        ("ask jane at example [dot] museum today", "email", "jane at example [dot] museum"),
        ("ask jane.roe at example.com today", "email", "jane.roe at example.com"),
        ("ask jane plus news at example dot com today", "email", "jane plus news at example dot com"),
        ("host 192 dot 168 dot 1 dot 10 is up", "ip", "192 dot 168 dot 1 dot 10"),
        ("host one nine two [dot] one six eight [dot] zero [dot] one is up", "ip", "one nine two [dot] one six eight [dot] zero [dot] one"),
        ("host one.two.three.four is up", "ip", "one.two.three.four"),
        ("call +1 415 five 55 12 three 4 ok", "phone", "+1 415 five 55 12 three 4"),
        ("call plus one four one five 555 1234 ok", "phone", "plus one four one five 555 1234"),
        ("call +1 five five five five five five five five five five ok", "phone", "+1 five five five five five five five five five five"),
        ("card 4111 1111 1111 １１１１ two days", "card", "4111 1111 1111 １１１１"),
        ("card four 111 1111 1111 1 one one 1 ok", "card", "four 111 1111 1111 1 one one 1"),
        ("host ｏｎｅ.2.3.4 is up", "ip", "ｏｎｅ.2.3.4"),
    ],
)
def test_disguises_fold_one_by_one(text, kind, source):
    base, added = d.find(text)
    assert (kind, source) in [(k, text[a:b]) for k, a, b in added]


@pytest.mark.parametrize("text", ["see us at example.com", "look at the dot on the map", "we met at one dot of ink", "two plus two", "jane@example", "I was at home. Come in"])
def test_words_that_are_no_disguise(text):
    assert d.find(text) == ([], [])


def test_disguises_are_linear():
    for text in ("a at b dot " * 40_000, "one " * 100_000, "dot " * 100_000, " " * 400 + "a.b " * 50_000, "plus " * 80_000, "a dot " * 60_000 + "@ b dot c"):
        d.find(text)
