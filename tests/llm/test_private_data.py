"""Personal data by the plain patterns, planted disguises, and edges."""

import hashlib
import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermalcube.llm import private_data
from thermalcube.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in re.sub(r"[^0-9]", "", m[0])]
            even = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and even % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def text_of(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_query_by_brute_force(spark):
    texts = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    rows = QUERIES["op12_disguised_private_data"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts.index)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(text_of(want).encode()).hexdigest()
        # The given texts hold no disguises: nothing is added to clean documents.
        assert r.spans == text_of(want) and r.n_disguised == 0


def test_plain_spans_of_random_texts():
    rng = random.Random(1)
    for _ in range(20_000):
        letters = rng.choice(["a@.1-", "0123. -+()", "a@.b@c.", "1.", "+1 -(", "25.0"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert private_data.plain_spans(text) == brute(text), text


DISGUISED = [
    ("email", "hsr.29 at mail5 dot example dot com"), ("email", "hsr.29 [at] mail5 [dot] example [dot] com"),
    ("email", "hsr.29(at)mail5.example.com"), ("email", "hsr.29 at mail5.example.com"), ("email", "jane AT example DOT org"),
    ("email", "jane (at) example (dot) org"), ("email", "jane dot doe at example dot org"), ("email", "jane.doe @ example . org"),
    ("email", "jane.doe＠example．org"), ("email", "jаne.dоe@exаmple.com"), ("email", "jane{at}example{dot}de"),
    ("email", "jane arroba ejemplo punto com"), ("email", "jane arobase exemple point fr"), ("email", "jane_at_example_dot_com"),
    ("email", "jane(a)example.com"), ("email", "jane<at>example<dot>com"), ("email", "hsг.29@mail5.example.com"),
    ("phone", "+１ (９８８) ５５５-２４８５"), ("phone", "plus one nine eight eight five five five two four eight five"),
    ("phone", "+1 nine eight eight 555-2485"), ("phone", "+1 (988) five five five 2485"), ("phone", "+1 (988) 555–2485"),
    ("phone", "plus vier neun eins sieben null drei zwei fünf sechs acht"),
    ("phone", "plus trois trois six un deux trois quatre cinq six sept huit"),
    ("card", "four nine eight four two five zero four eight nine six six nine six zero nine"),
    ("card", "4984 two five zero four 8966 nine six zero nine"), ("card", "498425O489669609"), ("card", "４９８４２５０４８９６６９６０９"),
    ("card", "4984​2504​8966​9609"), ("card", "𝟒𝟗𝟖𝟒 𝟐𝟓𝟎𝟒 𝟖𝟗𝟔𝟔 𝟗𝟔𝟎𝟗"),
    ("ip", "55[.]63[.]178[.]142"), ("ip", "55 dot 63 dot 178 dot 142"), ("ip", "one nine two dot one six eight dot zero dot one"),
    ("ip", "５５.６３.１７８.１４２"), ("ip", "55.63.l78.142"), ("ip", "55(dot)63(dot)178(dot)142"),
]


@pytest.mark.parametrize("kind,text", DISGUISED)
def test_disguises_are_found_at_their_place(kind, text):
    for before, after in (("", ""), ("Schöne Grüße é İ: ", ", bitte."), ("Wörter 한국 ", "\nund mehr")):
        whole = before + text + after
        spans = private_data.disguised_spans(whole, private_data.plain_spans(whole))
        assert (kind, len(before), len(before) + len(text)) in spans


@pytest.mark.parametrize("text", [
    "look at one point in time, meet me at example.com (a) foo.bar. At the. Than.", "one two three, four five. He said at two points.",
    "un 4984 dos 433716659846439 tres", "Section 1.2.3 (dot) plus two at most", "foo@bar.com. Next foo@bar.com point de un point foo@bar.com",
    "+1 (988) 555-2485 un de plus 3 at 10", "Москва мама ελλάδα", "",
])
def test_clean_texts_get_no_more_spans(text):
    plain = private_data.plain_spans(text)
    assert plain == brute(text) and private_data.disguised_spans(text, plain) == []


def test_rewritten_spans_come_back():
    got = private_data.rewrite("ab--cd**ef", [(2, 4, "X"), (6, 8, "")])
    assert got.text == "abXcdef"
    assert got.source(0, 2) == (0, 2) and got.source(2, 3) == (2, 4) and got.source(1, 7) == (1, 10)
    assert got.edited(1, 3) and got.edited(4, 6) and not got.edited(3, 5)


@pytest.mark.parametrize("part", ["a", "1", "one ", "a.a@", "1.1.1.", "at at ", "(at)", " dot", "а", "@a dot ", "[ at ", "-at-", "+1-", "double "])
def test_long_runs_take_linear_time(part):
    def seconds(n):
        text, start = part * n, time.perf_counter()
        private_data.disguised_spans(text, private_data.plain_spans(text))
        return time.perf_counter() - start

    assert seconds(80_000) < 12 * max(seconds(20_000), 0.02)


def test_edges(spark):
    rows = [(1, "x@y.z"), (1, "x@y.z"), (2, None), (3, ""), (None, "1.2.3.4"), (4, "word " * 300_000 + "x@y.z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (frame, frame.withColumns({c: F.lit("x") for c in ("spans", "n_email", "kind", "start")})):
        got = sorted(((r.doc_id, r.n_email, r.n_ip, r.spans) for r in private_data.find_private(docs).collect()), key=str)
        assert got == sorted([
            (1, 1, 0, "email:0:5"), (1, 1, 0, "email:0:5"), (2, 0, 0, ""), (3, 0, 0, ""), (None, 0, 1, "ip:0:7"),
            (4, 1, 0, "email:1500000:1500005"),
        ], key=str)
    assert private_data.find_private(frame.limit(0)).collect() == []
