"""Language ID and quality: held-out accuracy, and their arithmetic against plain recomputation."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerfold.llm import langid, quality
from ledgerfold.llm._text import mix, word_hashes
from ledgerfold.llm.queries import QUERIES


def test_language_is_right_on_texts_that_were_not_fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 40")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    found = langid.identify(docs.where("doc_id % 2 = 1"), model).select("lang", "language", "accepted")
    right = found.agg(F.avg((F.col("lang") == F.col("language")).cast("int"))).first()[0]
    assert right > 0.98


def test_language_edges(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    model = langid.fit(base)
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, "123 456 !!!", "de", "s"), (4, "x" * 50, None, "s"), (6, "the thing that they have " * 30_000, None, None), (5, "The thing that they have and with", None, None), (5, "The thing that they have and with", None, None)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, lang string, source string, language string, probability string")
    got = {r["doc_id"]: r["language"] for r in langid.identify(docs, model, declared=F.col("lang"), host=F.col("source")).collect()}
    assert (got[1], got[2], got[3], got[5], got[6]) == ("und", "und", "und", "en", "en")
    kept = langid.keep_accepted(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.where("doc_id = 5").collect()) == [5, 5]
    assert langid.keep_accepted(docs.limit(0), model).count() == 0
    unfitted = langid.fit(docs.limit(0))
    assert {r["language"] for r in langid.identify(docs, unfitted).collect()} == {"und"}


def test_evidence_decides_where_the_text_cannot(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang").where("length(text) > 200")
    model = langid.fit(base.withColumn("doc_id", F.monotonically_increasing_id()))
    hosts = base.where("lang in ('de', 'fr')").select("text", "lang", F.concat("lang", F.lit(".example.org")).alias("host"))
    short = spark.createDataFrame([("en", None, "de.example.org"), ("en", None, "fr.example.org")], "text string, lang string, host string")
    found = langid.identify(hosts.unionByName(short), model, declared=F.col("lang"), host=F.col("host")).where("text = 'en'")
    got = {r["host"]: r["language"] for r in found.collect()}
    assert got["fr.example.org"] != "de" and got["de.example.org"] != "fr"


def test_markup_and_addresses(spark):
    rows = [('<!DOCTYPE html><HTML class="a" lang="de-AT">', "https://m.Site.example.com/fr/825?x=1"), ("<p>", "http://a.example.de"), (None, None)]
    df = spark.createDataFrame(rows, "html string, url string")
    got = [tuple(r) for r in df.select(langid.markup_language("html"), langid.address_suffix("url"), langid.host_of("url"), langid.domain_of("url")).collect()]
    assert got == [("de", "/fr", "m.site.example.com", "example.com"), (None, "de", "a.example.de", "example.de"), (None, None, None, None)]


def test_pages_agree_with_their_markup(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    both = QUERIES["langid_pages"](spark, sf_dir).join(pages.select("page_id", langid.markup_language("html").alias("said")), "page_id")
    assert both.where("language = said").count() >= 0.95 * pages.count()


def test_quality_on_held_out_ratings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    ratings = labels.select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    model = quality.fit(docs, ratings.where("doc_id % 3 <> 0"))
    assert list(model.thresholds) == sorted(model.thresholds)
    held = quality.score(docs, model).join(ratings.where("doc_id % 3 = 0"), "doc_id")
    right = held.where("selected = (grade = 2)").count() / held.count()
    assert right > 0.9
    means = [r["m"] for r in held.groupBy("grade").agg(F.avg("expected_grade").alias("m")).orderBy("grade").collect()]
    assert means == sorted(means)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "word " * 50_000, 0), (3, "twice", 0), (None, "no id", 0)], "doc_id long, text string, selected int")
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert len({r["tail_probability"] for r in quality.score(docs, quality.fit(docs, none)).collect()}) == 1
    odd = spark.createDataFrame([(1, 2), (1, 0), (2, None), (9, 1), (3, 2), (None, 1)], "doc_id long, grade int")
    assert quality.score(docs, quality.fit(docs, odd)).count() == 5
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), odd)).count() == 0


def plain_identify(rows, model, weight=20.0, margin=1.0, least=0.5):
    """rows of (text, declared, suffix, host, domain): the fused posterior, evidence by evidence."""
    k, every = len(model.languages), range(len(model.languages))
    means, sizes = [], []
    for text, *_ in rows:
        bins = langid._bins(text or "")
        sizes.append(len(bins))
        means.append([sum(float(model.log_p[b, i]) for b in bins) / max(len(bins), 1) for i in every])
    guess = [max(every, key=lambda i: (m[i], -i)) if n else None for m, n in zip(means, sizes, strict=True)]
    n_l = [guess.count(i) for i in every]
    p_all = [(n + 1) / (sum(n_l) + k) for n in n_l]
    count = lambda at, value, i=None: sum(1 for r, g in zip(rows, guess, strict=True) if g is not None and value is not None and r[at] == value and i in (None, g))
    out = []
    for r, m, n in zip(rows, means, sizes, strict=True):
        logits = []
        for i in every:
            p = (count(4, r[4], i) + weight * p_all[i]) / (count(4, r[4]) + weight)
            e = math.log((count(3, r[3], i) + weight * p) / (count(3, r[3]) + weight))
            for at in (1, 2):
                if r[at] is not None:
                    e += math.log((count(at, r[at], i) + weight * (count(at, r[at]) + 1) / (sum(n_l) + 1)) / (n_l[i] + weight))
            logits.append(m[i] * min(n, 120) + e)
        best = max(every, key=lambda i: (logits[i], -i))
        sure = 1 / sum(math.exp(x - logits[best]) for x in logits)
        ok = n > 0 and m[best] >= -math.log(1 << 16) + margin and sure >= least
        out.append((model.languages[best] if ok else "und", round(sure, 5), ok))
    return out


def test_fused_posterior_is_that_of_plain_arithmetic(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    model = langid.fit(base)
    rows = []
    for i, r in enumerate(base.orderBy("doc_id").limit(120).collect()):
        text = None if i % 17 == 0 else r["text"][:300] if i % 3 else r["text"][: i % 23]
        rows.append((text, None if i % 5 == 0 else r["lang"], None if i % 4 else f"/{r['lang']}", None if i % 7 == 0 else f"h{i % 6}.{r['source']}", None if i % 7 == 0 else r["source"]))
    rows += rows[:5]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, said string, tld string, h string, d string")
    for parts in (1, 5):
        found = langid.identify(df.repartition(parts), model, declared=F.col("said"), suffix=F.col("tld"), host=F.col("h"), domain=F.col("d"), stay=("id",))
        got = [(r["language"], round(r["probability"], 5), r["accepted"]) for r in found.orderBy("id").collect()]
        want = plain_identify(rows, model)
        assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want]
        assert max(abs(x[1] - y[1]) for x, y in zip(got, want, strict=True)) < 1e-4


def test_language_sample_is_bounded_by_rows_and_leaves_no_label_out(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    texts = [r["text"] for r in base.orderBy("doc_id").limit(90).collect()]
    rows = [(7, f"repeated row number {i % 2}", "aa") for i in range(600)] + [(i, texts[i % 90] + f" {i}", f"l{i % 80:02d}") for i in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(labelled, per_language=1)
    assert model.languages == tuple(sorted({r[2] for r in rows}))
    once = langid.fit(spark.createDataFrame([(7, f"repeated row number {i}", "aa") for i in range(2)] * 2, "doc_id long, text string, lang string"))
    many = langid.fit(labelled.where("lang = 'aa'"))
    assert (once.log_p == many.log_p).all()


def test_languages_of_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op6_langid"](spark, "/root/testdata/sf0.01")
    both = found.join(docs.select("doc_id", "lang", "text"), "doc_id").where("length(text) >= 40")
    assert found.count() == docs.count() and found.where("accepted = (language = 'und')").count() == 0
    assert both.where("language = lang").count() >= 0.98 * both.count()


def test_quality_model_does_not_depend_on_how_rows_are_dealt(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfgklmnprstv" for b in ("anor", "elit", "ious")]
    texts = [" ".join(rng.choice(words[g * 12 : 12 + g * 14]) for _ in range(12)) for g in (0, 1, 2) for _ in range(40)]
    rows = [(i, texts[i % 120]) for i in range(400)] + [(3, texts[5]), (3, None), (None, texts[0])]
    grades = [(i, rng.randrange(3)) for i in range(400)] + [(3, 0), (3, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame(grades, "doc_id long, grade int")
    models = [quality.fit(docs.repartition(n), ratings.repartition(5 - n)) for n in (1, 2, 4)]
    assert all((m.weights == models[0].weights).all() and (m.thresholds == models[0].thresholds).all() for m in models)


def test_quality_scores_are_cumulative_link_probabilities(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(docs, labels.select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade")))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-1, None), (-2, ""), (-3, "42 !!"), (-4, "word " * 3000)]
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    table = 1 << 18
    for doc, text in rows:
        bare = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text or "").split(" ")
        bare = [w for w in bare if w]
        score = 0.0
        if bare:
            hashes = [int((h := next(word_hashes([w])))[0]) for w in bare]
            bins = [int(mix(np.array([h], np.uint64))[0] >> np.uint64(46)) for h in hashes]
            score = sum(float(model.weights[b]) for b in set(bins))
            raw = text.encode()
            kinds = [0] * 8
            for c in raw:
                kinds[1 if c > 127 else 0 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 if chr(c).isspace() else 4 if chr(c) in ".,;:!?'\"-()" else 5] += 1
            traits = [sum(a == b for a, b in zip(hashes, hashes[1:])) / len(bare), max(bins.count(b) for b in set(bins)) / len(bare), len(set(bins)) / len(bare)]  # noqa: B905
            score += sum(3 * t * float(model.weights[table + i]) for i, t in enumerate(traits + [k / len(raw) for k in kinds]))
        above = [1 / (1 + math.exp(-max(-40, min(40, score - cut)))) for cut in model.thresholds]
        assert abs(got[doc]["expected_grade"] - sum(above)) < 1e-4 and abs(got[doc]["tail_probability"] - above[-1]) < 1e-4
        assert got[doc]["selected"] == (got[doc]["tail_probability"] >= 0.5)


def test_language_stage_by_value(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = plain_identify([(r["text"], r["lang"], None, r["source"], None) for r in rows], langid.fit(docs))
    kept = {r["doc_id"] for r in langid.keep_accepted(docs, langid.fit(docs)).collect()}
    assert kept == {r["doc_id"] for r, (_, _, ok) in zip(rows, want, strict=True) if ok}
