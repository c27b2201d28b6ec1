from __future__ import annotations

import hashlib
import re

from strandlab.llm import pii
from strandlab.llm.common import documents
from tests.llm.cases import MESSY, ODD, SF, table

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    spans = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return sorted(spans)


def compare(df):
    text = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    rows = pii.find(df).collect()
    assert len(rows) == len(text)
    for r in rows:
        own = brute(text[r.doc_id])
        base = ",".join(s for _, _, s in own)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (r, base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(i == k for _, i, _ in own) for k in range(4)]
        assert set(s for _, _, s in own) <= set(r.spans.split(",")) | {""}
    return {r.doc_id: r for r in rows}


HARD = [
    (300, "a@b.c@d.ef x@y.z_q@r.s. %@-.-- 😀é me.you+x@host-1.co.uk, end"), (301, "1.2.3.4.5.6.7.8 0255.001.2.3 256.1.1.1 99999999999999999999.1.1.1"), (302, "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 49927398716 " + "1 " * 30_000),
    (303, "+1 (171) 555-2028 +12 +123456789012345678 +1 2 3 4 5 6 7 8 9 0) +49.30.123456-78"), (304, "9" * 40_000 + " 12.34.56.78"), (305, "a" * 60_000 + "@" + "b" * 9 + ".cc"), (306, "1" + ".1" * 20_000),
    (307, "please mail me: jo.doe [at] site [dot] org soon"), (308, "call (212) 555-0187 now, order 212-555-0187"),
]


def test_base_spans(spark):
    compare(documents(spark, SF))
    got = compare(table(spark, ODD + HARD))
    assert "email:16:" in got[307].spans and "phone:5:19" in got[308].spans and got[308].n_added == 1
    assert got[5].spans == "" and got[3].spans == ""


def test_added_spans(spark):
    """Each kind has a threshold; an added span goes only where it overlaps one that stays."""
    trees, limits = pii.fitted(spark)
    assert all(v < 1e9 for v in limits.values()), limits
    texts = [(1, "the server 10 . 0 . 0 . 7 is up, host 192[.]168[.]1[.]20 too"), (2, "version 10 . 0 . 0 . 7 of page 900[.]168[.]1[.]20"), (3, "call 030 1234 5678 now"), (4, "order 030 1234 5678 now")]
    got = {r.doc_id: r.spans for r in pii.find(table(spark, texts)).collect()}
    at = texts[0][1].index("192")
    assert got == {1: f"ip:11:25,ip:{at}:{at + len('192[.]168[.]1[.]20')}", 2: "", 3: "phone:5:18", 4: ""}


def test_messy_and_empty(spark):
    assert len(pii.find(table(spark, MESSY)).collect()) == len(MESSY)
    assert pii.find(table(spark, [])).collect() == []


def test_clean_text_gets_nothing(spark):
    clean = [(i, t) for i, t in enumerate(["Version 1.2.3 of page 12-34 has 1,000,000 rows.", "On 2024-01-02 at 10:30 we met (room 101).", "order 123-456-7890 ref 555.123.4567"])]
    assert all(r.spans == "" for r in pii.find(table(spark, clean)).collect())
