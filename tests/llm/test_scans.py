"""Secrets, personal data: the queries' digests against plain regular expressions."""

import hashlib
import re
import time

import pytest

from ledgerfold.llm import pii, secrets
from ledgerfold.llm.queries import QUERIES

EDGE = [
    (1, None), (2, ""), (3, "   "), (4, "token=abc token='abcdefgh12' SECRET: x_y-z.w=/+"), (5, "AKIA" + "Z9" * 8 + " AKIA12 AKIAAKIAAKIAAKIA"),
    (6, "f" * 32 + "g" + "0" * 31), (7, "token=token:abcdefgh"), (8, "é😀 api_key = \"ABCDEFGHIJ\" é"), (4, "token=abc token='abcdefgh12' SECRET: x_y-z.w=/+"),
    (9, "x" * 300_000 + " password:0123456789abcdef0123456789abcdef "), (None, "secret=abcdefgh"),
]
PERSONAL = [
    (1, None), (2, ""), (3, "a@b.c @x.y a@b a.b@@c.d+e@f.g.h."), (4, "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3"), (5, "4111 1111 1111 1111 4111-1111-1111-1112 5"),
    (6, "+1 (234) 555-0199 +12 +1-2 ++4915112345678 +123456789012345678"), (7, "é😀 ü@é.de ü@ab.de 10.0.0.1"), (7, "é😀 ü@é.de ü@ab.de 10.0.0.1"),
    (8, "9" * 50_000 + " a@b.cd"), (9, "0" * 3000 + ".1.01.1 1.1.1." + "0" * 3000 + "7x 12.34.56.78.90.1 1.2.3.256.7"), (10, "1.2.3 .4.5.6.7 4 1 1 1-1111 11111111.1.1.1"),
    (None, "IBAN DE89 3704 0044 0532 0130 00 http://bob:pw@host.org"),
]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted((s, i, e, k) for i, k, s, e in spans))


def plain_secrets(t):
    t, out = t or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A | re.I):
        if len(m[2]) >= 8:
            out.append((0, "assign", *m.span()))
    out += [(1, "access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [(2, "hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]


def plain_pii(t):
    t, out = t or "", []
    out += [(0, "email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, "ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    digits = lambda x: re.sub("[^0-9]", "", x)
    out += [(2, "card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, "phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def expect(rows, plain):
    return sorted((d is None, d or 0, hashlib.sha256(joined(plain(t)).encode()).hexdigest()) for d, t in rows)


def digests(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["base_sha256"]) for r in df.collect())


def test_secret_digest(spark, tmp_path):
    df = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("blob", secrets.F.lit("clash")).withColumn("spans", secrets.F.lit(1))
    got = secrets.digest(secrets.run(df, str(tmp_path / "ledger")))
    assert digests(got) == expect(EDGE, plain_secrets)
    row = got.where("doc_id = 8").first()
    assert (row["n_assign"], row["spans"], row["n_found"]) == (1, "assign:3:24", 1)


def test_ledger_scans_only_what_it_lacks(spark, tmp_path):
    df = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "AKIA" + "A" * 16)], "doc_id long, text string")
    path = str(tmp_path / "ledger")
    used = lambda rows: sorted(sorted(x["rule"] for x in r["rules"]) for r in rows)
    first = secrets.scan_unseen(df.where("doc_id < 3"), secrets.read_ledger(spark, path), secrets.RULES[:1])
    assert used(first.collect()) == [["assign"]]
    first.write.parquet(path)
    more = secrets.scan_unseen(df, secrets.read_ledger(spark, path), secrets.RULES[:2])
    assert used(more.collect()) == [["access"], ["access", "assign"]]
    more.write.mode("append").parquet(path)
    assert secrets.scan_unseen(df, secrets.read_ledger(spark, path), secrets.RULES[:2]).count() == 0
    newer = (("assign", 2, secrets.RULES[0][2]),)
    assert secrets.scan_unseen(df, secrets.read_ledger(spark, path), newer).count() == 2
    spans = {r["doc_id"]: r["spans"] for r in secrets.at_paths(secrets.addresses(df), secrets.read_ledger(spark, path)).collect()}
    assert [len(spans[i]) for i in (1, 2, 3)] == [1, 1, 1]


@pytest.mark.parametrize("order", [(2, 0, 1, 5, 4, 3), (5, 4, 3, 2, 1, 0)])
def test_runs_in_any_order_give_what_one_run_gives(spark, tmp_path, order):
    texts = ["token=abcdefgh AKIA" + "A" * 16 + " " + "f" * 40, "secret: " + "0" * 40, "plain", None, "ghp_" + "a" * 40 + " password=" + "b" * 33]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    whole = secrets.digest(secrets.run(df, str(tmp_path / "one")))
    path = str(tmp_path / "several")
    for k in order[:-1]:
        secrets.run(df.where(f"doc_id % 3 <> {k % 3}"), path, (secrets.RULES[k],)).count()
    parts = secrets.digest(secrets.run(df, path))
    # An equal run once more, as after a retry.
    secrets.read_ledger(spark, path).write.parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("append").parquet(path)
    again = secrets.digest(secrets.run(df, path))
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(whole) == rows(parts) == rows(again)


def test_a_rule_version_replaces_the_one_before(spark, tmp_path):
    df = spark.createDataFrame([(1, "token=abcdefgh AKIA" + "A" * 16)], "doc_id long, text string")
    path = str(tmp_path / "ledger")
    assert secrets.digest(secrets.run(df, path)).first()["spans"] == "assign:0:14,access:15:35"
    newer = (("assign", 2, lambda text: iter(())), *secrets.RULES[1:])
    assert secrets.digest(secrets.run(df, path, newer)).first()["spans"] == "access:15:35"
    assert secrets.digest(secrets.run(df, path)).first()["spans"] == "assign:0:14,access:15:35"


def test_pii_digest(spark):
    df = spark.createDataFrame(PERSONAL, "doc_id long, text string").withColumn("spans", secrets.F.lit("clash"))
    got = pii.digest(pii.scan(df))
    assert digests(got) == expect(PERSONAL, plain_pii)
    assert got.where("doc_id is null").first()["spans"] == "iban:5:32,login:40:55,email:44:55"


def test_long_runs_of_digits_take_time_in_proportion():
    anchors, began = pii._anchors(), time.monotonic()
    assert pii.find("0" * 5000 + ".1.1.1", anchors) == [(0, 1, 5006)]
    assert pii.find("7" * 5_000_000 + " a@b.cd", anchors) == [(5_000_001, 0, 5_000_007)]
    assert len(pii.find("1." * 300_000 + "+1(" + "(" * 300_000 + "@" + "a" * 300_000, anchors)) == 75_000
    assert time.monotonic() - began < 60


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd now", "x"), (2, None, "y")], "doc_id long, text string, other string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()} == {1: "mail <email> now", 2: None}


@pytest.mark.parametrize("name, plain", [("op4_secrets", plain_secrets), ("op7_pii", plain_pii)])
def test_whole_table(spark, sf_dir, name, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES[name](spark, sf_dir)
    assert digests(got) == expect(rows, plain)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.digest(secrets.run(none, str(tmp_path / "ledger"))).count() == 0
    assert pii.digest(pii.scan(none)).count() == 0
