"""Decontamination, licences, near-duplicates and the pipeline against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerfold.llm import _hnsw, decontamination, embeddings, jaccard, licenses
from ledgerfold.llm._store import connected_components, recorded
from ledgerfold.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def plain_components(rows, k, num):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    u, ids = Union(sets), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * len(sets[a] | sets[b]):
                u.join(a, b)
    return {d: (len(sets[d]), u.root(d)) for d in ids}


def near_copies(n, seed, size=60, changes=6):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(changes)):
            copy[rng.randrange(size)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(copy))
    return out


def test_components_of_stars_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(1, 2), (2, 3), (3, 1), (5, 5)]
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    assert got == {x: u.root(x) for x in u.up if x != 5}
    assert connected_components(df.limit(0)).count() == 0


def test_jaccard_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op10_jaccard"](spark, sf_dir).collect()}
    assert got == plain_components(rows, 4, 85)


def test_jaccard_long_lists_and_edges(spark):
    texts = near_copies(70, 1) + near_copies(40, 2, changes=14) + ["same text here for all to see"] * 30
    passage = " ".join(f"p{i}" for i in range(30))
    rng = random.Random(3)
    texts += [passage + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 90))) for _ in range(60)]
    texts += [None, "", " \t", "one", "ONE", "one two three", "a b c d e", "long " * 30_000, "é ü"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, digest string, n int").repartition(3)
    for k, num in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs, k=k, num=num, merged=6).collect()}
        assert got == plain_components(rows, k, num)


def test_jaccard_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard.components(docs).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted((r["doc_id"] or 0) for r in jaccard.keep_one(docs).collect()) == [0, 1, 3]
    assert jaccard.components(docs.limit(0)).count() == 0


def plain_overlap(doc, item, least=12, identity=0.8, fewest=10):
    best = 0
    for shift in range(-len(item) + 1, len(doc)):
        equal = [p for p in range(len(item)) if 0 <= p + shift < len(doc) and item[p] == doc[p + shift]]
        for i in range(len(equal)):
            for j in range(i, len(equal)):
                if j - i + 1 >= identity * (equal[j] - equal[i] + 1) - 1e-9:
                    best = max(best, j - i + 1)
    return best if best >= least or fewest <= best == len(item) else 0


def test_masks_hit_every_pattern_of_a_fifth_replaced():
    rng = random.Random(1)
    for length in range(12, 41):
        replaced = length - max(12, math.ceil(0.8 * length - 1e-9))
        inner = range(1, length - 1)
        patterns = itertools.combinations(inner, replaced) if length <= 16 else (rng.sample(inner, replaced) for _ in range(3000))
        for gone in map(set, patterns):
            assert any(all(at + p not in gone for p in mask) for mask in decontamination.MASKS for at in range(length - max(mask))), (length, gone)


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    items = [[f"i{k}_{p}" for p in range(n)] for k, n in enumerate((40, 18, 15, 12, 11, 10, 9))]
    docs = []
    for item in items:
        for changed in (0, 1, 2, 3, 5, 8, 8, 8):
            passage = list(item)
            for at in rng.sample(range(len(item)), min(changed, len(item))):
                passage[at] = "sub"
            docs.append(fresh(20) + passage + fresh(rng.randrange(40)))
    docs += [items[0][:11] + fresh(30), items[0][5:25], fresh(50), [], ["one"], ["one", "two"] * 60_000 + items[1] + ["end"]]
    d = spark.createDataFrame([(i, " ".join(x), "clash") for i, x in enumerate(docs)] + [(900, None, ""), (2, " ".join(docs[2]), "")], "doc_id long, text string, item_id string")
    t = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(items)] + [(9, None), (9, ""), (0, " ".join(items[0]))], "item_id long, text string")
    rows = decontamination.overlaps(d, t).collect()
    found = {(r["doc_id"], r["item_id"]): r["same_words"] for r in rows}
    want = {(i, k): n for i, x in enumerate(docs) for k, y in enumerate(items) if len(x) < 1000 and (n := plain_overlap(x, y))} | {(len(docs) - 1, 1): 18}
    assert found == want and len(rows) == len(found)
    kept = decontamination.clean(d, t)
    assert kept.columns == d.columns and 900 in {r["doc_id"] for r in kept.collect()}
    assert decontamination.overlaps(d.limit(0), t).count() == decontamination.overlaps(d, t.limit(0)).count() == 0


@pytest.mark.parametrize("doc_type, item_type", [("smallint", "string"), ("string", "int"), ("decimal(10,2)", "date")])
def test_decontamination_takes_ids_of_any_type(spark, doc_type, item_type):
    text = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, text), (2, "other"), (None, text)], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(doc_type))
    item = F.to_date(F.lit("2024-05-06")) if item_type == "date" else F.lit("7").cast(item_type)
    t = spark.createDataFrame([(text,)], "text string").select(item.alias("item_id"), "text")
    got = decontamination.overlaps(d, t)
    assert got.schema["doc_id"].dataType.simpleString() == doc_type and got.schema["item_id"].dataType.simpleString() == item_type
    assert sorted(r["same_words"] for r in got.collect()) == [20, 20]


def test_decontamination_finds_every_planted_item(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_decontamination"](spark, sf_dir).collect()}
    inside = lambda x, y: f" {' '.join(words(x))} " in f" {' '.join(words(y))} "
    assert {(d["doc_id"], i["item_id"]) for d in docs for i in items if len(words(i["text"])) >= 12 and inside(i["text"], d["text"])} <= got


def test_licences(spark):
    rows = [
        (1, "src/LICENSE", "Released under the MIT License."), (2, "src/a/x.py", "some words\nno notice"), (3, "src/a/LICENSE", "Licensed under CC BY-NC 4.0."),
        (4, "src/a/b/y.py", "text of a file"), (5, "other/z", "nothing"), (6, "src/q", "blah blah\nThis work is licensed under the GNU General Public License, version 3.\nblah"),
        (7, None, "text"), (8, "src/n", None), (9, "top", "free"), (10, "src/w", "the law of the land and the license of the poet " * 3),
    ]
    filler = [(100 + i, f"other/f{i}", "the and of in this is under work to by words " * 4) for i in range(30)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows + filler], "doc_id long, path string, text string, licence string")
    got = {r["doc_id"]: (r["licence"], r["origin"]) for r in licenses.inherit(docs.select("doc_id", "path"), licenses.detect(docs)).collect()}
    assert {i: got[i] for i in range(1, 11)} == {
        1: ("MIT", "own"), 2: ("CC-BY-NC-4.0", "inherited"), 3: ("CC-BY-NC-4.0", "own"), 4: ("CC-BY-NC-4.0", "inherited"), 5: (None, "none"),
        6: ("GPL-3.0", "own"), 7: (None, "none"), 8: ("MIT", "inherited"), 9: (None, "none"), 10: ("MIT", "inherited"),
    }
    none = docs.limit(0)
    assert licenses.inherit(none.select("doc_id", "path"), licenses.detect(none)).count() == 0


def test_licence_cosine_is_that_of_tf_idf(spark):
    texts = ["Released under the MIT License.", "Licensed under CC BY 4.0.", "plain words", "the license under the mit tree"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    templates = (("MIT", "Released under the MIT License."), ("CC", "Licensed under CC BY 4.0."))
    tokens = lambda t: re.sub(r"[^a-z0-9]+", " ", t.lower()).split()
    df = {}
    for t in texts:
        for w in set(tokens(t)):
            df[w] = df.get(w, 0) + 1
    vocabulary = {w for _, t in templates for w in tokens(t)}
    idf = {w: math.log(5 / (df[w] + 1)) if w in vocabulary else math.log(5) for w in df}
    vec = lambda t: {w: tokens(t).count(w) * idf[w] for w in tokens(t)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    a, b = vec(texts[3]), vec(templates[0][1])
    want = sum(a.get(w, 0) * b[w] for w in b) / norm(a) / norm(b)
    got = {r["doc_id"]: (r["licence"], r["score"]) for r in licenses.detect(docs, templates, threshold=0.01).collect()}
    assert got[0] == ("MIT", 1.0) and got[1] == ("CC", 1.0) and got[3][0] == "MIT" and abs(got[3][1] - want) < 1e-5


@pytest.mark.parametrize("rows", [[7] * 6, [7] * 7, [3, *[7] * 6, 8, 8, 9], [7] * 5, [7] * 11])
def test_no_piece_of_a_long_list_is_short_or_lost(rows):
    column = lambda x: pa.array(np.array(x, np.int64))
    docs = list(range(100, 100 + len(rows)))
    none = pa.array([False] * len(rows))
    table = pa.RecordBatch.from_arrays([column(rows), column(rows), column(docs), column([9] * len(rows)), column([1] * len(rows)), none], ["g", "h", "doc", "n", "weight", "split"])
    batches = [table.slice(at, 5) for at in range(0, len(rows), 5)]
    out = [tuple(r.values()) for b in jaccard._merge_lists(3, 80, 100, 4)(iter(batches)) for r in b.to_pylist()]
    held = [d for h, d in zip(rows, docs, strict=True) if h == 7]
    assert sorted(a for h, a, *_ in out if h == 7) == held
    assert not [r for r in out if r[0] == 0 and r[3] > 0 and r[1] in held]


@pytest.mark.parametrize("rest", [1, 2, 16, 17])
def test_lists_beyond_a_piece_keep_every_document(rest):
    n = (1 << 16) + rest
    column = lambda x: pa.array(np.full(n, x, np.int64))
    table = pa.RecordBatch.from_arrays([column(5), column(5), pa.array(np.arange(n)), column(9), column(1), pa.array(np.zeros(n, bool))], ["g", "h", "doc", "n", "weight", "split"])
    out = pa.Table.from_batches(jaccard._merge_lists(16, 80, 100, (1 << 16) - 1)(table.slice(at, 1 << 15) for at in range(0, n, 1 << 15)))
    h, a, b, c = (out.column(x).to_numpy() for x in "habc")
    assert sorted(a[h == 5]) == list(range(n)) and not c[h == 0].any()
    pivots = set(a[(h == 5) & (c == 1)])
    assert {*a[h == 0], *b[h == 0], *pivots} == set(range(n)) and len(pivots) == 2


def test_parts_of_a_list_of_one_row_are_long():
    rows = [(1, 7, 10, True), (2, 7, 11, True), (3, 8, 12, False), (4, 7, 13, True), (4, 7, 14, True)]
    g, h, doc, split = (pa.array(list(x)) for x in zip(*rows, strict=True))
    same = pa.array([9] * 5)
    table = pa.RecordBatch.from_arrays([g, h, doc, same, same, split], ["g", "h", "doc", "n", "weight", "split"])
    out = [r for b in jaccard._merge_lists(16, 80, 100)(iter([table.slice(0, 2), table.slice(2)])) for r in b.to_pylist()]
    assert sorted((r["h"], r["a"], r["b"], r["c"]) for r in out) == [(0, 13, 14, 0), (7, 10, 0, 1), (7, 11, 0, 1), (7, 13, 0, 1), (7, 14, 0, 0)]


def test_near_duplicates_of_lists_in_pieces(spark):
    rows = list(enumerate(near_copies(57, 3) + near_copies(4, 4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 5)
    try:
        for options in ({"most": 4}, {"piece": 3}, {"piece": 5, "most": 4, "merged": 2}):
            found = jaccard.components(docs, **options)
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
            assert got == plain_components(rows, 5, 80), options
        assert int(spark.conf.get(name)) == 5
    finally:
        spark.conf.set(name, before)


def test_a_hub_of_a_list_in_pieces_is_met_by_all(spark):
    """Near copies that link with their original alone: the original is the pivot of every piece."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)] * 3
    for i in range(80):
        copy = list(base)
        for at in rng.sample(range(120), 2):
            copy[at] = f"x{i}_{at}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard.components(docs, k=4, num=85, merged=3, piece=6)
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(d, c) for d, (_, c) in plain_components(list(enumerate(texts)), 4, 85).items()}


def test_long_lists_of_many_components(spark, monkeypatch):
    """A passage that most documents are made of, with chains of near copies across the blocks of its lists."""
    monkeypatch.setattr(jaccard, "_BLOCK", (7, 7))
    rng = random.Random(6)
    passages = [" ".join(f"p{j}_{i}" for i in range(24)) for j in range(3)]
    texts = [" ".join([*rng.sample(passages, rng.randrange(1, 4)), *(f"y{rng.randrange(6)}" for _ in range(rng.randrange(7)))]) for _ in range(150)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({"merged": 3}, {"merged": 3, "piece": 10}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs, **options).collect()}
        assert got == plain_components(rows, 5, 80)


def plain_licences(rows, threshold=0.7):
    """rows of (doc_id, path, text), ids unique: (licence, score, origin) by id, line by line and template by template."""
    marks = {ord(c): " " for c in ".,;:()[]\"'/-*#\t\r"}
    tokens = lambda t: [w for w in re.split("[ \n]+", t.lower().translate(marks)) if w]
    texts = {d: t for d, _, t in rows if t is not None}
    vocabulary = {w for _, t in licenses.TEMPLATES for w in tokens(t)}
    df = dict.fromkeys(vocabulary, 0)
    for t in texts.values():
        for w in vocabulary & set(tokens(t)):
            df[w] += 1
    n = len(rows)
    idf = {w: math.log((n + 1) / min(df[w] + 1, n + 0.5)) for w in vocabulary}
    vector = lambda ws: {w: ws.count(w) * idf.get(w, math.log(n + 1)) for w in set(ws)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(tokens(t))) for name, t in licenses.TEMPLATES]
    found = {}
    for d, t in texts.items():
        best, held = None, {"line": 0, "paragraph": 0}
        units = [("line", x) for x in t.split("\n")] + [("paragraph", x) for x in re.split("\n[ \t\r]*\n", t) if "\n" in x]
        for kind, unit in units:
            ws = tokens(unit)
            if not set(ws) & vocabulary:
                continue
            v = vector(ws)
            scores = [(-round(sum(v.get(w, 0) * y[w] for w in y) / (norm(v) * norm(y)), 6), name) for name, y in templates if norm(v) * norm(y)]
            if scores and -min(scores)[0] >= threshold:
                held[kind] += len(ws)
                best = min(best or (0, ""), min(scores))
        if best:
            found[d] = (best[1], -best[0], min(1, max(held.values()) / len(tokens(t))))
    parent = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    files = {}
    for d, p, _ in rows:
        if p is not None and d in found and found[d][2] >= 0.1:
            files.setdefault(parent(p), []).append((-found[d][2], p, found[d][:2]))
    out = {}
    for d, p, _ in rows:
        if d in found:
            out[d] = (*found[d][:2], "own")
            continue
        at = None if p is None else parent(p)
        while at is not None and at not in files:
            at = parent(at) if at else None
        out[d] = (*min(files[at])[2], "inherited") if at is not None else (None, None, "none")
    return out


def test_licences_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", licenses.document_path().alias("path"), "text").collect()]
    got = {r["doc_id"]: (r["licence"], r["score"], r["origin"]) for r in QUERIES["op5_licenses"](spark, sf_dir).collect()}
    want = plain_licences(rows)
    assert {d: (x[0], x[2]) for d, x in got.items()} == {d: (x[0], x[2]) for d, x in want.items()}
    assert all(abs((got[d][1] or 0) - (want[d][1] or 0)) < 2e-6 for d in want) and "own" in {x[2] for x in want.values()}


@pytest.mark.parametrize("share", [0.03, 0.06, 0.5, 1.0])
def test_licences_by_brute_force_at_any_frequency(spark, share):
    rng = random.Random(int(100 * share))
    notices = [t for _, t in licenses.TEMPLATES]
    wrapped = "\n".join(" * " + x for x in ("Permission is hereby granted, free of charge, to any person", "obtaining a copy of this software and associated", "documentation files."))
    rows = []
    for i in range(200):
        body = " ".join(rng.choice(("tree", "house", "the", "of", "license", "software", f"w{rng.randrange(99)}")) for _ in range(rng.randrange(1, 40)))
        if i < 200 * share:
            body = f"{body}\n{notices[1 + i % 3]}\n{body}" if i % 2 else f"{body}\n\n{wrapped}\n\nend"
        rows.append((i, f"a/{'b/' * (i % 3)}{'c/' * (i % 5 == 0)}f{i}", body))
    rows += [(900, "a/LICENSE", None), (901, None, notices[2]), (902, "top", "x " * 200_000 + "\n" + notices[4]), (903, "a/b/LICENSE", notices[6]), (904, "a/x", ""), (905, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = licenses.inherit(docs.select("doc_id", "path"), licenses.detect(docs)).collect()
    want = plain_licences(rows)
    assert {r["doc_id"]: (r["licence"], r["origin"]) for r in found} == {d: (x[0], x[2]) for d, x in want.items()}
    assert sum(x[2] == "own" for x in want.values()) >= 200 * share


def test_licences_of_repeated_rows(spark):
    rows = [(1, "a/x", "Released under the MIT License."), (1, "a/x", "Released under the MIT License."), (1, "a/y", "plain"), (2, "a/z", "plain"), (None, "a/q", "Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = sorted((r["doc_id"] or 0, r["path"], r["licence"], r["origin"]) for r in licenses.inherit(docs.select("doc_id", "path"), licenses.detect(docs)).collect())
    assert got == [(0, "a/q", "MIT", "inherited"), (1, "a/x", "MIT", "own"), (1, "a/x", "MIT", "own"), (1, "a/y", "MIT", "own"), (2, "a/z", "MIT", "inherited")]


@pytest.mark.parametrize("every", [1, 3])
def test_a_licence_of_a_large_part_of_the_documents_is_found(spark, every):
    notices = [t for _, t in licenses.TEMPLATES]
    texts = [f"first line {i}\n{notices[0]}\nlast line" if i % every == 0 else f"plain text {i}" for i in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), *((1000 + i, t) for i, t in enumerate(notices))], "doc_id int, text string")
    got = {r["doc_id"]: (r["licence"], r["score"]) for r in licenses.detect(docs).collect()}
    assert {d: s for d, s in got.items() if d < 1000} == {d: ("Apache-2.0", 1.0) for d in range(0, 120, every)}
    assert all(got[1000 + i] == (name, 1.0) for i, (name, _) in enumerate(licenses.TEMPLATES))
    alone = licenses.detect(docs.where("doc_id < 1000 and doc_id % 3 = 0")).collect()
    assert len(alone) == 40 and all(r["score"] == 1.0 for r in alone)


def test_lines_left_out_cannot_reach_the_threshold():
    rng = random.Random(5)
    for _ in range(300):
        weights = {f"w{i}": rng.choice([0.01, 1, 1, 3, 20]) * rng.random() + 1e-6 for i in range(rng.randrange(1, 9))}
        threshold = rng.choice([0.01, 0.5, 0.7, 0.95])
        words, k = licenses._heaviest(weights, threshold)
        left = [*words[: k - 1], *(w for w in weights if w not in words)]
        best = math.sqrt(sum(weights[w] ** 2 for w in left) / sum(x * x for x in weights.values()))
        assert round(best, 6) < threshold


def plain_links(rows, cosine=0.95):
    good = [(i, v) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, u = [0] * len(good), Union({i for i, _ in good})
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for _, v in good]
    for a in range(len(good)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                links[b] += 1
                u.join(good[a][0], good[b][0])
    return sorted((i, n, u.root(i)) for (i, _), n in zip(good, links, strict=True))


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(40):
        centre = rng.normal(size=16)
        for _ in range(40 if c == 0 else 8):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + 0.15 * rng.normal(size=16)]))
    rows += [(900 + i, rows[3][1]) for i in range(20)] + [(950, [2 * x for x in rows[5][1]]), (951, [1.0, 2.0]), (952, [2.0, 4.1]), (953, [1e30] * 16), (954, [1e-30] * 16)]
    bad = [(960, None), (961, []), (962, [0.0] * 16), (963, [None, 1.0]), (964, [float("nan")] * 16), (965, [float("inf")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows + bad], "vec_id long, embedding array<float>, class string, n int")
    got = embeddings.near_duplicates(df, shard_rows=60, part_rows=100).collect()
    good = {i for i, _ in rows}
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] in good) == plain_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None and r["vec_id"] >= 960} == {(i, 0, i) for i in range(960, 966)}
    assert len(got) == len(rows) + len(bad) and embeddings.near_duplicates(df.limit(0)).count() == 0


def test_links_of_a_large_group_are_counts_not_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.ones(8) + 0.02 * rng.normal(size=8)], 1, 8) for i in range(240)]
    found = embeddings.links(spark.createDataFrame(rows, "key long, embedding array<float>, n long, dim int"), 0.95, 16, 0.99, 16, 100_000, 80).collect()
    assert len(found) <= 8 * 3 * (80 + 30) and {r["key"] for r in found} == set(range(240))
    count = dict.fromkeys(range(240), 0)
    for r in found:
        count[r["key"]] += r["links"]
    assert set(count.values()) == {239}


def test_search_gives_the_pairs_of_a_large_group_a_bounded_number_at_a_time():
    rng = np.random.default_rng(10)
    x = (np.ones(8) + 0.02 * rng.normal(size=(4096, 8))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, most = np.zeros(512, np.int64), 0
    for r, _ in _hnsw.search(x, _hnsw.build(x), x[:512], 48, 0.95):
        most = max(most, len(r))
        found += np.bincount(r, minlength=512)
    assert (found == 4096).all() and most * 64 <= 32 << 20


def test_graphs_and_blocks_are_bounded_by_bytes_and_read_one_by_one(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64)]) for i in range(600)]
    rows += [(600 + i, [x + 0.001 for x in v]) for i, v in rows[:50]]
    with recorded() as paths:
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = embeddings.near_duplicates(df, width=8, shard_bytes=8192).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == plain_links(rows)
    for name, column in (("graphs", "held"), ("blocks", "raw")):
        (path,) = [p for p in paths if f"/{name}-" in p]
        table = spark.read.parquet(path)
        assert table.count() >= 650 * 64 * 4 // 8192 and table.agg(F.max(F.length(column))).first()[0] <= 4 * 8192
        for file in table.inputFiles():
            of = pq.ParquetFile(file.removeprefix("file://")).metadata
            assert all(of.row_group(k).num_rows == 1 for k in range(of.num_row_groups))


def test_embeddings_of_one_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [-1.0, 0.0]), (0, [-1.0, 0.01])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 0, False)]


def test_embeddings_whole_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = QUERIES["op9_embeddings"](spark, sf_dir).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == plain_links(rows)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = jaccard.materialize(stage(spark, docs, sf_dir), "stage")
        out.append(docs)
    return out


def test_pipeline_stages(spark, sf_dir, stages):
    first = stages[0]
    assert all(s.columns == first.columns for s in stages[:-1])
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert len(ids[1]) >= 0.95 * len(ids[0])
    rows = [tuple(r) for r in stages[1].select("doc_id", "text").collect()]
    plain = plain_components(rows, 5, 80)
    assert ids[2] == {d for d, (_, c) in plain.items() if c == d}
    hit = {r["doc_id"] for r in decontamination.overlaps(stages[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert ids[3] == ids[2] - hit
    last = stages[-1]
    assert last.groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    slots = last.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.count_distinct("slot").alias("distinct"))
    assert all(r["n"] == r["distinct"] == r["top"] + 1 for r in slots.collect())
    assert last.count() == stages[-2].count()


def test_pipeline_keeps_odd_columns_and_rows(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(10**6).cast("long"), "text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    odd = odd.withColumns({"language": F.lit("x"), "size": F.lit(1), "digest": F.lit("y"), "key": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = jaccard.materialize(stage(spark, odd, sf_dir), "stage")
        assert odd.columns[-4:] == ["language", "size", "digest", "key"]
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), sf_dir).count() == 0


def test_a_stage_deletes_what_the_one_before_left(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    lazy = corpus_pipeline.language_id(spark, docs, sf_dir)
    left = list(corpus_pipeline._LEFT)
    assert left and all(spark.read.parquet(p).columns for p in left)
    # Documents that are still read from these tables keep them.
    kept = corpus_pipeline.decontaminate(spark, lazy, sf_dir)
    assert set(corpus_pipeline._LEFT) & set(left) and kept.count() <= 40
    written = jaccard.materialize(kept, "stage")
    corpus_pipeline.shard(spark, written, sf_dir).count()
    assert not set(corpus_pipeline._LEFT) & set(left) and written.count() <= 40
