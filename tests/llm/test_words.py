import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import wordblocks as wb

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ 09\t\n\x0b-éßЖ文\xa0.", max_size=30)), max_size=8)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_words_are_those_of_the_patterns(texts):
    column = pa.array(texts, pa.string())
    buf, offs = wb.raw(column)
    for table, pattern in ((wb.SPACED, r"[^\x20\x09-\x0D]+"), (wb.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        starts, ends, ptr = wb.spans(buf, offs, table)
        found = wb.words(buf, starts, ends)
        for i, t in enumerate(texts):
            assert found[ptr[i] : ptr[i + 1]] == re.findall(pattern, lower(t or ""))


def test_hashes_tell_words_apart_and_ignore_case_and_place():
    many = [f"w{i}" for i in range(20_000)]
    buf, offs = wb.raw(pa.array([" ".join(many), " ".join(many).upper()]))
    starts, ends, ptr = wb.spans(buf, offs, wb.SPACED)
    h = wb.hashes(buf, starts, ends)
    assert len(np.unique(h)) == len(many)
    assert (h[: ptr[1]] == h[ptr[1] :]).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abB文", min_size=1, max_size=90), min_size=1, max_size=20), st.lists(st.text(alphabet="abB文", min_size=1, max_size=90), min_size=1, max_size=20))
def test_equal_words(one, two):
    n = min(len(one), len(two))
    parts = []
    for own in (one[:n], two[:n]):
        buf, offs = wb.raw(pa.array([" ".join(own)]))
        parts += [wb.LOWER[buf], *wb.spans(buf, offs, wb.SPACED)[:2]]
    assert wb.equal(*parts).tolist() == [lower(a) == lower(b) for a, b in zip(one, two, strict=False)]
    for key in (0, 5):
        h = [wb.hashes(*parts[k : k + 3], key) for k in (0, 3)]
        assert (h[0] == h[1]).tolist() == [lower(a) == lower(b) for a, b in zip(one, two, strict=False)]


def test_blocks_cover_all_rows():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 100, "", "c"])], names=["text"])
    parts = list(wb.blocks([batch, batch.slice(0, 0)], limit=20))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 1
