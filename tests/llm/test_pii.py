import hashlib
import math
import re

from proplytics.llm import pii
from tests.llm.support import documents, edge_rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ODD = [
    "a@b.c_d@e.f x@y", "a@b.c.x@y.z .@a.b a@.b@c.d", "1-2-3-4 4111 1111 1111 1111 4111-1111-1111-1112 4111  1111", "1.2.3.4.5.6.7.8.9 300.1.1.1 0001.2.3.4 1.2.3.99999999999999999999",
    "+1 (017) 555-7713 +1((( +12 +1234567 +12345678 +123456789012345 +1234567890123456", "\x01a@b.c\x03d 1\x014", "é\U0001f600 a@b.co +44 20 7946 0958",
    "4" * 16 + " " + "1 " * 3000, "4111111111111111" * 3 + " 41111111111111111 4012888888881881", "a" * 50000, "a.b" * 3000 + "@" + "c.d" * 3000, "+4111 1111 1111 1111",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m) for m in (EMAIL.finditer(text) if "@" in text else ())]
    out += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_base_spans_equal_the_patterns(spark):
    rows = edge_rows() + [(500 + i, t, "s") for i, t in enumerate(ODD)]
    got = pii.digest(pii.sanitised(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(brute(t))
    for r in got:
        found = next((w for w in want[r.doc_id] if hashlib.sha256(",".join(w).encode()).hexdigest() == r.base_sha256), None)
        assert found is not None, r
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in found) for k in ("email", "ip", "card", "phone")]
        assert r.spans.split(",")[: len(found)] == (found or [""])[: len(found)] or r.spans == ",".join(found)


def test_terms_that_stand_beside_a_value_only(spark):
    rows = [(i, f"plain words number{i} about nothing of interest here", "s") for i in range(200)]
    rows += [(300 + i, f"Reach Zaphod of Betelgeuse about plain thing{i} at z@heart.example today", "s") for i in range(6)]
    rows += [(400 + i, "Betelgeuse is a star beside plain words", "s") for i in range(60)]
    rows += [(500, "Zaphod alone, in a clean text", "s")]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in pii.digest(pii.sanitised(docs)).collect()}
    words = {i: {rows_text[int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in got[i].spans.split(",") if s) if k == "term"}
             for i, rows_text, _ in rows}
    assert "zaphod" in words[300] and "plain" not in words[300] and "thing0" not in words[300]
    assert "betelgeuse" not in words[300]  # far more often elsewhere
    assert all(not words[i] for i in words if not 300 <= i < 306)  # clean texts are left alone
    cleaned = {r.doc_id: r.text for r in pii.clean_texts(docs).collect()}
    assert "[EMAIL]" in cleaned[300] and "Zaphod" not in cleaned[300] and cleaned[500] == rows[-1][1]


def test_copies_of_one_text_give_nothing_away(spark):
    rows = [(i, "Somebody unusual writes from me@home.example with rare words", "s") for i in range(9)] + [(50 + i, f"other text {i}", "s") for i in range(40)]
    assert all(r.n_term == 0 for r in pii.digest(pii.sanitised(documents(spark, rows))).collect())


def test_no_rows_and_columns(spark):
    assert pii.sanitised(documents(spark, [])).collect() == []
    docs = documents(spark, edge_rows())
    cleaned = pii.clean_texts(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()


def test_a_value_of_one_text_has_terms_once_it_is_rare_enough(spark):
    rows = [(i, f"plain words of row {chr(97 + i % 26)} here", "s") for i in range(3000)]
    rows = [(i, f"{t} {''.join(chr(97 + int(d)) for d in str(i))}x", s) for i, t, s in rows]
    rows += [(5000 + i, "Ask Li or Zaphod about plain words by me@home.example", "s") for i in range(4)]
    rows += [(6000, "Only here stands Trillian in plain words", "s")]
    docs = documents(spark, rows, clash=False)
    got = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    text = rows[-2][1]
    words = {text[t["first"] : t["last"]]: t["ratio"] for t in got[5000]["terms"]}
    assert {"Li", "Zaphod"} <= set(words) and not {"plain", "words"} & set(words)
    # four copies are one text: 3,002 texts, and one text leaves a bit of doubt
    assert abs(words["Zaphod"] - math.log2((1 + 1 / 3002) / 2 * 3002) / math.log2(3002)) < 1e-9
    assert all(got[5000 + i]["terms"] == got[5000]["terms"] for i in range(4)) and not got[6000]["terms"]
    cleaned = {r.doc_id: r.text for r in pii.clean_texts(docs).where("doc_id = 5000").collect()}
    assert "Li" not in cleaned[5000] and "L- " in cleaned[5000] and "[EMAIL]" in cleaned[5000]


def test_terms_beside_a_shared_domain(spark):
    rows = [(i, f"plain words of text {''.join(chr(97 + int(d)) for d in str(i))}x", "s") for i in range(400)]
    rows += [(500 + i, f"plain words at Magrathea from {chr(97 + i)}@planet.example", "s") for i in range(12)]
    got = {r.doc_id: r for r in pii.sanitised(documents(spark, rows, clash=False)).collect()}
    assert all("Magrathea" in {s["value"] for s in got[500 + i]["spans"] if s["kind"] == 4} for i in range(12))
    assert not any(got[i]["terms"] for i in range(400))
