from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text: str):
    """The contract, straight from its patterns."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@._-+19 ()é4\n", max_size=40))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_known_spans():
    t = "é mail a.b@x-y.co.uk, ip 10.0.0.255 and 10.0.0.256, card 4111 1111 1111 1111, tel +1 (555) 010-9999"
    assert [t[a:b] for _, a, b in pii.base_spans(t)] == ["a.b@x-y.co.uk", "10.0.0.255", "4111 1111 1111 1111", "+1 (555) 010-9999"]


def test_checksums_and_context():
    good, bad = "transfer to IBAN GB82 WEST 1234 5698 7654 32 now", "transfer to IBAN GB82 WEST 1234 5698 7654 33 now"
    assert [s[0] for s in pii.find_spans(good)] == ["iban"] and pii.find_spans(bad) == []
    assert pii.find_spans("my social security 123-45-6789")[0][3] > pii.find_spans("version 123-45-6789", least=0)[0][3]
    assert pii.find_spans("version 123-45-6789") == []


def test_long_runs_are_linear():
    for unit in ("a", "1", "1.", "@", "a@", "+1", "1 "):
        pii.find_spans(unit * 200_000)


def test_redact():
    t = "write to a@b.co or +1 555 010 9999!"
    assert pii.redact(t, pii.find_spans(t)) == "write to <EMAIL> or <PHONE>!"


def test_rows(spark, make_docs):
    docs = make_docs(["a@b.co", None, "", "a@b.co"], [1, 2, None, 1 << 60]).selectExpr("*", "'x' as spans", "array(1) as more")
    got = {(r.doc_id, r.text): r for r in pii.find_pii(docs, redacted="clean").collect()}
    assert set(got) == {(1, "a@b.co"), (2, None), (None, ""), (1 << 60, "a@b.co")}
    assert got[2, None].spans == [] and got[2, None].clean is None and got[1, "a@b.co"].clean == "<EMAIL>" and got[1, "a@b.co"].more == [1]
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    import hashlib

    import pandas as pd

    texts = pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id").text
    for r in pii.op8_pii(spark, sf_dir).collect():
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[0] == k for w in want) for k in pii.KINDS)
