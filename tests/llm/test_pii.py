import random
import re

from pyspark.sql import functions as F

from slideframe.llm import pii


def brute(text):
    """The base spans straight from their definitions."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_against_definitions():
    r = random.Random(2)
    bits = ["a", "B.c", "@", "@x", ".com", "1", "255", "256", "0007", ".", "-", " ", "+", "+1", "(", ")", "é", "日", "4111111111111111", "\n", "_", "%", "378282246310005"]
    for _ in range(30000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(24)))
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_are_linear():
    for t in ["a" * 300_000 + "@", "1" * 300_000, "a@" * 100_000, "1." * 150_000, "+1 " * 100_000, "+1" + " " * 200_000, "x" * 300_000 + "@a.de"]:
        pii.find_spans(t)
    assert pii.base_spans("x" * 300_000 + "@a.de") == [(0, 0, 300_005)]


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    text = "Konto DE89 3704 0044 0532 0130 00 heute"
    assert pii.joined(pii.find_spans(text)) == "iban:6:33"
    assert pii.find_spans(text.replace("3704", "3705")) == []
    assert pii.find_spans("see 123-45-6789") == []
    assert pii.joined(pii.find_spans("SSN 123-45-6789")) == "ssn:4:15"
    assert pii.joined(pii.find_spans("call 555-123-4567")) == "tel:5:17"
    assert pii.find_spans("mail x@y.de")[0].score > pii.find_spans("order x@y.de")[0].score


def test_rows(spark):
    rows = [(1, "é a@b.de 1.2.3.4"), (2, None), (3, ""), (None, "+49 (30) 123456"), (1, "é a@b.de 1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("id", F.lit(1))
    got = pii.detect(df).collect()
    assert [(g["id"], g["n_email"], g["n_ip"], g["n_card"], g["n_phone"], g["base"]) for g in got] == [
        (1, 1, 1, 0, 0, "email:2:8,ip:9:16"), (2, 0, 0, 0, 0, ""), (3, 0, 0, 0, 0, ""), (None, 0, 0, 0, 1, "phone:0:15"), (1, 1, 1, 0, 0, "email:2:8,ip:9:16")]
    assert [g["text"] for g in pii.redacted(df).collect()] == ["é [EMAIL] [IP]", None, "", "[PHONE]", "é [EMAIL] [IP]"]
    assert pii.detect(df.limit(0)).collect() == []
