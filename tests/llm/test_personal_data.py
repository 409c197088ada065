import hashlib
import random
import re

import pyarrow as pa
import pytest

from tidewright.llm import personal_data as pd_


def naive(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or pd_.luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_plain_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789. -+()@ab") for _ in range(rng.randint(0, 60)))
        assert pd_.base_spans(text) == naive(text), text


DISGUISED = [
    ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
    ("bob{at}mail{dot}example{dot}net", "email", "bob{at}mail{dot}example{dot}net"),
    ("john dot smith at mail dot example dot org.", "email", "john dot smith at mail dot example dot org"),
    ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"),
    ("mail john -at- example -dot- com now", "email", "john -at- example -dot- com"),
    ("write john at example.com today", "email", "john at example.com"),
    ("john@example dot com", "email", "john@example dot com"),
    ("user＠example.com", "email", "user＠example.com"),
    ("call plus one 5 five five 555 0199 now", "phone", "plus one 5 five five 555 0199"),
    ("＋１ ５５５ 123 4567", "phone", "＋１ ５５５ 123 4567"),
    ("card four one one one one one one one one one one one one one one one end", "card", "four" + " one" * 15),
    ("4111​1111​1111​1111", "card", "4111​1111​1111​1111"),
    ("ip one nine two dot one six eight dot zero dot one x", "ip", "one nine two dot one six eight dot zero dot one"),
    ("192[.]168[.]1[.]10", "ip", "192[.]168[.]1[.]10"),
]


@pytest.mark.parametrize(("text", "kind", "span"), DISGUISED)
def test_disguises_map_back_to_the_source(text, kind, span):
    base, added = next(pd_.find(pa.array([text])))
    assert base == naive(text)
    s = text.index(span)
    assert (s, pd_.KINDS.index(kind), s + len(span)) in added


@pytest.mark.parametrize("text", ["look at example.com now", "it is available at www.example.com.", "The one at that. Two or three", "un deux trois", "meet at 10.30 or at 12.45.", "hi at bo.42@mail.example.com x", "Привет, мир. 文字"])
def test_clean_text_gains_nothing(text):
    assert next(pd_.find(pa.array([text])))[1] == []


@pytest.mark.parametrize(
    "text",
    ["john[@]example.com", "john (@) example.com", "john(a)example.com", "+49 170 five five 1234567", "192.168.one.one", "bo.42 at my-host.com", "1 2.3.4.5", "bob@example .com", "jo_AT_host[.]de", "+4 FÜNF 2 3 4 5 6 7 8 9 1", "x ÄT y dot com"],
)
def test_every_disguise_is_looked_for(text):
    base, added = next(pd_.find(pa.array([text])))
    assert added and added == pd_.added_spans(text, base)
    assert next(pd_.find(pa.array(["foo", text, "bar"])[1:]))[1] == added


def test_find_is_added_spans_without_the_gate():
    rng = random.Random(3)
    bits = ["at", "AT", "ät", "Ät", "a", "@", "chez", "arroba", "dot", "Punkt", "point", ".", ".", "(", ")", "[", "]", "{", "<", ">", "_", "*", "-", " ", " ", " ", "\n", "\x1c"]
    bits += ["john", "example", "com", "de", "my-host", "plus", "+", "1", "7", "25", "411", "one", "Five", "fünf", "FÜNF", "zéro", "dos", ",", "/", "×", "é", "е", "١", "bo.42"]
    numbers = ["1", "7", "one", "Five", "FÜNF", "zéro", "4", "0", "dos", "nine"]
    found = [0] * 4
    texts = []
    for _ in range(30_000):
        kind = rng.randrange(4)
        if kind == 0:
            texts.append("".join(rng.choices(bits, k=rng.randint(1, 14))))
        elif kind == 1:
            at, dot = rng.choice(["@", "[@]", "(a)", " at ", "_at_", "< AT >", " @ ", "ät", "-chez-"]), rng.choice([".", " .", "[.]", " dot ", "_punkt_", " . ", "( point )"])
            texts.append(rng.choice(["", "a ", "x."]) + "bo1" + at + rng.choice(["host", "my-host", "-", "é"]) + dot + "com" + rng.choice(bits))
        elif kind == 2:
            dot = rng.choice([".", " .", "[.]", " dot ", "_punkt_", " . "])
            texts.append(dot.join("".join(rng.choice(["", " ", "-"]) + rng.choice(numbers) for _ in range(rng.randint(1, 2))) for _ in range(rng.choice([3, 4, 4, 5]))))
        else:
            texts.append(rng.choice(["", "+", "plus ", "+ ", "PLUS  ", "s"]) + "".join(rng.choice(["", " ", "-", ". ", "x"][: rng.choice([2, 4, 4, 5])]) + rng.choice(numbers) for _ in range(rng.randint(8, 19))))
    for text, (base, added) in zip(texts, pd_.find(pa.array(texts)), strict=True):
        assert added == pd_.added_spans(text, pd_.base_spans(text)), text
        for _, k, _ in added:
            found[k] += 1
    assert min(found) > 40


def test_plain_spans_are_not_lengthened():
    assert next(pd_.find(pa.array(["évi ouvi. +1 (848) 555-1373 Un an"]))) == ([(10, 3, 27)], [])


@pytest.mark.parametrize("text", ["a" * 300 + " (at) example (dot) com", "card 4111.1111.1111.1111 ok", "call +49/30/1234567890 now", ".".join(["word"] * 200) + " (at) example (dot) com", "bo -dot-smith (at) host.com"])
def test_spans_of_any_length_and_alone(text):
    base, added = next(pd_.find(pa.array([f"x; {text}"])))
    want = (text.find("4") if text[0] == "c" and text[1] == "a" and "4111" in text else text.find("+") if "+" in text else 0) + 3
    assert [s for s, _, _ in added] == [want]
    assert next(pd_.find(pa.array([f"x; {text} ’“x”"])))[1] == added


def test_query_columns(spark, docs, empty, texts):
    extra = docs.unionByName(spark.createDataFrame([(900, "é a.b@c.de +1 (555) 555-1234 1.2.3.4", "en", "s", 1, "x", 1, 0.1)], docs.schema))
    got = {r["doc_id"]: r for r in pd_.identifiers(extra).collect() if r["doc_id"] is not None}
    assert got[900]["spans"] == "email:2:10,phone:11:36,ip:29:36"
    assert got[900]["base_sha256"] == hashlib.sha256(got[900]["spans"].encode()).hexdigest()
    assert (got[900]["n_email"], got[900]["n_ip"], got[900]["n_card"], got[900]["n_phone"]) == (1, 1, 0, 1)
    assert got[30]["spans"] == "" and got[30]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pd_.identifiers(extra).count() == extra.count()
    assert pd_.identifiers(empty).count() == 0
    assert pd_.redacted(extra).where("doc_id = 900").first()["text"] == "é [EMAIL] [PHONE]"
    assert pd_.redacted(extra).columns == extra.columns


def test_long_runs_stay_linear():
    pd_.base_spans("a" * 300_000 + "1" * 300_000 + "1." * 100_000)
    pd_.added_spans("a." * 200_000 + "(at) x (at) x.com " + "a dot b at " * 20_000 + "x@" * 50_000, [])
    pd_.added_spans("one " * 50_000 + "(" * 100_000 + " " * 50_000, [])
