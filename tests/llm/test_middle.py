"""Fill-in-middle against a plain reading of its definition and against SQL."""

import hashlib
import random
import re

import duckdb
import pytest

from terravox.llm import middle

from .test_corpus import empty, odd

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(text, doc_id):
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", " ", "a", " a ", "é ü x\t漢字 😀\n", "<P> held", "a <M", "S> < P>", "<S", ">x <", "\x0b\x0c\x1f \x85 y", "a " * 500, " " * 300, "w" * 5000, "漢" * 3000 + " x"]


@pytest.mark.parametrize(("step", "block"), [(1, 1), (2, 3), (64, 1 << 20), (3, 64), (5, 7)])
def test_checkpoints_find_every_unit(step, block):
    rng = random.Random(step)
    for text in TEXTS + ["".join(rng.choice("ab é漢\t\n😀") for _ in range(120)) for _ in range(60)]:
        units, ends, at = middle.Units(text.encode(), step, block), [0], 0
        for u in UNIT.findall(text):
            ends.append(at := at + len(u))
        assert units.n == len(ends) - 1
        assert units.counts[1:] == list(range(step, len(re.findall(r"[^\x20\x09-\x0D]+", text)) + 1, step))
        for k in range(0, len(ends), 1 + len(ends) // 60):
            assert units.end(k) == (len(text[: ends[k]].encode()), ends[k])


def test_transform_and_way_back():
    forms = set()
    for i in [*range(400), None]:
        text = TEXTS[(i or 0) % len(TEXTS)]
        got = middle.transform(text.encode(), i, 50, 80, 42)
        assert got == (*plainly(text, i)[:4], plainly(text, i)[4].encode())
        assert middle.restore(got[4], got[1]) == text.encode()
        forms.add(got[1])
    assert forms == {"plain", "spm", "psm"}


def test_query_is_its_sql(spark, sf):
    got = sorted(map(tuple, middle.query(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    assert got == sorted(con.execute(middle.oracle()).fetchall())


def test_odd_tables(spark):
    rows = odd(spark).collect()
    got = middle.fill_in_middle(odd(spark)).collect()
    want = sorted(((r.doc_id is None, r.doc_id, *plainly(r.text or "", r.doc_id)) for r in rows), key=repr)
    assert sorted(((r.doc_id is None, r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    for r in got:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
    assert {r.restored_sha256 for r in got} == {hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows}
    assert middle.fill_in_middle(empty(spark)).count() == 0
