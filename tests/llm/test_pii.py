import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tesserae.llm import pii
from tests.llm.conftest import make

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": "[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(2 * int(c) - 9 * (int(c) > 4) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0
    return True


def base(text):
    return sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if passes(k, m.group()))


def check(df, rows):
    by = {}
    for r in df.select("doc_id", "text").collect():
        by.setdefault(r["doc_id"], []).append(r["text"] or "")
    for r in rows:
        wanted = {hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base(t)).encode()).hexdigest() for t in by[r["doc_id"]]}
        assert r["base_sha256"] in wanted, by[r["doc_id"]]


def test_documents(small):
    rows = pii.sanitise(small).collect()
    assert len(rows) == small.count()
    check(small, rows)


def test_odd_and_empty(odd, empty):
    rows = pii.sanitise(odd).collect()
    assert len(rows) == odd.count()
    check(odd, rows)
    assert pii.sanitise(empty).count() == 0


def test_made_texts(spark):
    random.seed(9)
    letters = "ab1204.@-+ ()_%\n9é"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1111-1111", "+1 (555) 010-9999.", "é a@b.co", "4111111111111111 4111111111111111", "x" * 3000 + "@y.z", "1" * 4000]
    df = make(spark, texts)
    check(df, pii.sanitise(df).collect())


def test_terms_that_give_an_entity_away(spark):
    told = [f"Please write to kim@corp.example about projekt Zanzibar today {k}" for k in range(6)]
    plain = [f"please write about something else today number {k}" for k in range(60)]
    df = make(spark, told + plain)
    rows = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    for k in range(6):
        terms = {told[k][int(a) : int(b)].lower() for kind, a, b in (s.split(":") for s in rows[k]["spans"].split(",")) if kind == "term"}
        assert {"zanzibar", "projekt"} <= terms and not {"please", "write", "about", "today"} & terms
    assert all(rows[k]["spans"] == "" for k in range(6, 66))


def test_sanitised_text(spark):
    told = [f"Please write to kim@corp.example about projekt Zanzibar today {k}" for k in range(6)]
    plain = [f"please write to others about something else today number {k}" for k in range(60)]
    rows = {r["doc_id"]: r for r in pii.sanitise(make(spark, [*told, *plain, None])).collect()}
    assert rows[3]["sanitised"] == "Please write to [EMAIL] about   today 3"
    assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in rows[3]["found"]) == rows[3]["spans"]
    assert all(rows[k]["sanitised"] == plain[k - 6] for k in range(6, 66)) and rows[66]["sanitised"] is None


def test_terms_on_other_lines_and_short_ones(spark):
    told = [f"Xu Li\nnotes of the day {k}\n\nkim@corp.example" for k in range(4)]
    plain = [f"notes of the day\nand of the {k} next\nother{k}@corp.example" for k in range(50)]
    rows = {r["doc_id"]: r for r in pii.sanitise(make(spark, told + plain)).collect()}
    assert all(r["spans"] == "term:0:2,term:3:5,email:" + r["spans"].split("email:")[1] for k, r in rows.items() if k < 4)
    assert all(r["n_term"] == 0 for k, r in rows.items() if k >= 4)


def test_very_many_matches(spark):
    text = " ".join(f"10.0.{k % 256}.{k // 256 % 256}" for k in range(100_000))
    got = make(spark, [text, text[:50]]).select("doc_id", F.size(pii.base_spans(F.col("text"))).alias("n"), pii.joined(pii.base_spans(F.col("text"))).alias("s")).collect()
    want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base(text) if k == "ip")
    assert got[0]["s"] == want and got[0]["n"] == 100_000


def test_redacted(spark):
    df = spark.createDataFrame([("mail a@b.co or +1 555 010 9999 now",)], "t string")
    assert df.select(pii.redacted(F.col("t"), pii.base_spans(F.col("t")))).first()[0] == "mail [EMAIL] or [PHONE] now"


@pytest.mark.parametrize(("digits", "good"), [("4111111111111111", True), ("4111111111111112", False), ("378282246310005", True)])
def test_luhn(spark, digits, good):
    assert spark.createDataFrame([(digits,)], "d string").select(pii.luhn(F.col("d"))).first()[0] is good
