import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerfold.llm import mixing, sharding
from ledgerfold.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Water filling, source by source, until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return share | fixed
        fixed |= {s: most * sizes[s] for s in above}


def check_mix(rows, got):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = plain_targets(sizes)
    source_of = {d: s for d, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    return want


def digest(plan):
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    return plan.withColumn("taken", taken).collect()


def test_mix_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    first, again = (sorted(map(tuple, QUERIES["op1_mixing"](spark, sf_dir).collect()), key=repr) for _ in range(2))
    assert first == again
    check_mix(rows, QUERIES["op1_mixing"](spark, sf_dir).collect())


def test_mix_edges(spark):
    rows = [(1, "a b c", "s"), (2, None, "s"), (3, "  ", None), (4, "x " * 5000, "hot"), (5, "one", "tiny"), (6, "p q", None), (7, None, "void"), (8, "é ü z", "u")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, size string, bucket int")
    want = check_mix(rows, digest(mixing.curriculum(docs)))
    assert want["tiny"] == 3 and want["void"] == 0
    none = mixing.curriculum(docs.limit(0))
    assert none.count() == 0
    alone = digest(mixing.curriculum(docs.where("doc_id = 2")))
    assert [(r["size"], r["taken"]) for r in alone] == [(0, 0)]


def test_moments_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 2}") for i in range(400)], "doc_id long, text string, source string")
    tilted = lambda sizes: sizes.select(
        "skey", F.when(F.col("source") == "s0", F.expr("array(named_struct('t', 0D, 'w', 2D), named_struct('t', 1D, 'w', 0D))")).otherwise(
            F.expr("array(named_struct('t', 0D, 'w', 0D), named_struct('t', 0.5D, 'w', 0D), named_struct('t', 1D, 'w', 4D))")).alias("knots"))
    plan = mixing.curriculum(docs, tilted)
    rows = docs.join(plan, "doc_id").select("source", F.explode("parts.moment").alias("m")).collect()
    share = lambda s, t: sum(r["m"] < t for r in rows if r["source"] == s) / sum(r["source"] == s for r in rows)
    assert abs(share("s0", 0.5) - 0.75) < 0.02 and share("s1", 0.49) <= 0.01 and abs(share("s1", 0.75) - 0.25) < 0.02
    order = [r["doc_id"] for r in mixing.in_order(docs, plan).collect()]
    assert len(order) >= 398 and order[0] % 2 == 0 and order[-1] % 2 == 1


def test_mix_gives_every_row_its_own_parts(spark):
    rows = [(i if i % 4 else None, f"t{i} b c d e", "s") for i in range(40)] + [(900, f"u{i} b c d e", "s") for i in range(5)] + [(901, "same b c d e", "s")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.mix(spark, docs, None)
    assert got.columns == docs.columns
    # One source is its own target: every row is taken once.
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


def test_mix_stage_is_the_plan_in_order(spark, sf_dir):
    """Sequence and repeats of the stage by value: documents by their moments, as plain arithmetic gives them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], len(WORD.findall(r["text"] or "")), r["source"]) for r in docs.collect()]
    sizes = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    target, order = plain_targets(sizes), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    want = []
    for source in order:
        # A weight of 1 falls from 3/2 to 1/2, one of 3 rises from 1/2 to 3/2; their integral is 1.
        tilt = (2 - weight[source]) / 2
        mine = sorted((hashlib.md5(f"0:{d}".encode()).hexdigest(), n, d) for d, n, s in rows if s == source)
        for turn in range(3):
            at = turn * sizes[source]
            for _, n, d in mine:
                if at < target[source]:
                    share, b = at / target[source], 1 + tilt
                    moment = share if tilt == 0 else (b - (b * b - 4 * tilt * share) ** 0.5) / (2 * tilt)
                    if 2 * min(n, -int(at - target[source]) + ((target[source] - at) % 1 > 0)) >= n:
                        want.append((round(moment, 7), d))
                at += n
    got = [r["doc_id"] for r in corpus_pipeline.mix(spark, docs, None).collect()]
    moments = dict.fromkeys(d for _, d in want)
    assert sorted(got) == sorted(d for _, d in want)
    exact = sorted(want)
    # Equal moments aside, the order is that of the moments.
    for d, (m, e) in zip(got, exact, strict=True):
        assert d == e or any(abs(x - m) < 1e-6 for x, y in exact if y == d), (d, e, m)
    assert len(moments) <= len(rows)


def least_capacity(sizes, shards):
    def needs(c):
        n, held = 1, 0
        for s in sizes:
            if held + s > c:
                n, held = n + 1, 0
            held += s
        return n

    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needs(mid) <= shards else (mid + 1, high)
    return low


def check_shards(rows, got):
    by_id = {}
    for r in got:
        by_id.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_id.values())
    shard_of, size_of, load = {}, {}, {}
    texts = {}
    for d, t in rows:
        texts.setdefault(d, t)
    for r in got:
        t = texts[r["doc_id"]]
        raw = (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert shard_of.setdefault(t, r["shard"]) == r["shard"]
        size_of[t] = size_of.get(t, 0) + r["size"]
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    ordered = [size_of[t] for t in sorted(size_of, key=lambda t: "" if t is None else hashlib.sha256(t.encode()).hexdigest())]
    assert max(load.values()) == least_capacity(ordered, 8)


def test_shards_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op8_sharding"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    check_shards(rows, got)


def test_shards_edges(spark):
    rows = [(i, "same") for i in range(40)] + [(50, None), (51, None), (52, ""), (53, "x" * 100_000), (54, "é"), (54, "é")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, shard string")
    check_shards(rows, sharding.assign(docs).collect())
    assert sharding.assign(docs.limit(0)).count() == 0
    few = sharding.assign(docs.where("doc_id in (50, 52)")).collect()
    assert sorted(r["slot"] for r in few) == [0, 0]


@pytest.mark.parametrize("seed", range(6))
def test_least_capacity_by_blocks_is_that_of_all_groups(spark, seed):
    rng = random.Random(seed)
    n = (1, 9, 60, 400, 1500, 1500)[seed]
    groups = {hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(): rng.choice((1, 3, 40)) * rng.randrange(1, 60) for i in range(n)}
    if seed > 3:  # a third of everything in one group, and large ones beside it
        for k, at in enumerate(sorted(groups)[:: n // 3]):
            groups[at] = sum(groups.values()) // (2 + 3 * k)
    df = spark.createDataFrame([(d, 1) for d in groups] + [(d, s - 1) for d, s in groups.items() if s > 1], "digest string, size long")
    for shards, digits in ((8, 1), (3, 2)):
        got, cuts = sharding.minimax_cuts(df, shards, digits, 1)
        sizes = [groups[d] for d in sorted(groups)]
        assert got == least_capacity(sizes, shards)
        want, held = [], 0
        for d in sorted(groups):
            if held + groups[d] > got:
                want.append(before)
                held = 0
            held, before = held + groups[d], d
        assert cuts == want and len(cuts) < shards


def test_sharding_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y", 1), (2, "b", None, "z", 2)], "doc_id long, text string, digest string, bucket string, row int").withColumn("law", F.lit("old"))
    got = sharding.assign(docs)
    assert got.columns == ["doc_id", "text", "digest", "bucket", "row", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted((r["digest"] or "", r["bucket"], r["row"], r["law"]) for r in got.collect()) == [("", "z", 2, "bytes"), ("x", "y", 1, "bytes")]
