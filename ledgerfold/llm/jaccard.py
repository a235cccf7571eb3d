"""N-gram Jaccard join by T-occurrence search.

A document is the set of its word shingles. A partner has to share T of a document's n shingles, so
it occurs in at least m of the lists of any n - T + m of them. As in DivideSkip, the long lists
stand last in that choice: shingles that are frequent among some thousand documents are set aside, the
short lists of the others are merged (here by the shuffle's sort) and occurrences counted, a
document's long lists count as if they held the partner, and the sets of the candidates that can
still reach m are probed by binary search. Which lists are long decides the work, never the result.

Documents with equal sets form a class and are searched once. Components are what is asked for, so
in a list of more than ``merged`` documents each is first compared with a pivot alone; once those
links are united, documents outside the list's largest component are compared with those of other
components, after bounds by size and by a bit sketch of the sets. No list is cut off, and no link that
could join two components is missed.

A list of a shingle that is frequent among some thousand documents is dealt to pieces of about
``piece`` documents before the shuffle. Each piece also gets the pivots of the whole list, the heaviest class
of each range of sizes; other pivots that it needs meet those of other pieces afterwards, and so do
those of what a piece beyond ``most`` rows is cut into. A frequent list needs no task of its own.

A null, empty or blank text has an empty set and links with nothing; very long texts are read whole. Rows
that repeat an id are one document, which links by any of its texts. A null id links with nothing. Ids are
integers. Without rows the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm._store import connected_components, discard, materialize, small_batches, spread_join
from ledgerfold.llm._text import shingles, slices, word_hashes

#: Most shingles set aside as frequent, a bound of what is broadcast; it shifts work, not results.
_FREQUENT = 1 << 17
#: A shingle is reported as frequent if so many different sets hold it among so many documents.
_SEEN, _SEEN_AMONG = 4, 4096
_SKETCH = 16  # words of 64 bits
_MAP_BITS = 1 << 24
#: Documents of a long list that are compared in one piece with as many others: a share of all, within these bounds.
_BLOCK = (1024, 8192)
#: Pieces into which a list of all documents is dealt, and the least size of a piece.
_PIECES, _LEAST_PIECE = 512, 512


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for at in range(0, len(texts), 512):
        for words in word_hashes(texts.slice(at, 512).to_pylist()):
            yield np.unique(shingles(words, k))


def _describe(k: int):
    """(doc_id, n, digest, frequent): the last only on the first row of some thousand."""

    def flush(ids: list, sizes: list, digests: list, distinct: dict) -> pa.RecordBatch:
        frequent: list = [None] * len(sizes)
        if distinct:
            values, counts = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
            often = counts >= _SEEN
            frequent[0] = [{"shingle": int(v), "n": int(c)} for v, c in zip(values[often].view(np.int64), counts[often], strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
             pa.array(frequent, pa.list_(pa.struct([("shingle", pa.int64()), ("n", pa.int64())])))],
            ["doc_id", "n", "digest", "frequent"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, digests, distinct = [], [], [], {}
        for batch in slices(batches):
            ids.append(batch.column("doc_id"))
            for s in _sets(batch.column("text"), k):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None
                sizes.append(len(s))
                digests.append(digest)
                if digest:
                    distinct[digest] = s
            if len(sizes) >= _SEEN_AMONG:
                yield flush(ids, sizes, digests, distinct)
                ids, sizes, digests, distinct = [], [], [], {}
        if sizes:
            yield flush(ids, sizes, digests, distinct)

    return work


def _prefixes(k: int, frequent: np.ndarray, num: int, den: int):
    """(doc, n, prefix, sketch): the shingles whose lists are merged, and parities of hashed shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, prefixes, sketches = [], [], []
            for s in _sets(batch.column("text"), k):
                n = len(s)
                sizes.append(n)
                if n:
                    at = np.minimum(np.searchsorted(frequent, s), max(len(frequent) - 1, 0))
                    late = frequent[at] == s if len(frequent) else np.zeros(n, bool)
                    ordered = np.concatenate([s[~late], s[late]])
                    prefixes.append(ordered[: n - -(-num * n // den) + int(_needed(n))].view(np.int64))
                    odd = np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=64 * _SKETCH) & 1
                    sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                else:
                    prefixes.append(np.zeros(0, np.int64))
                    sketches.append(np.zeros(_SKETCH, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc", "n", "prefix", "sketch"],
            )

    return work


def _by_list(
    batches: Iterator[pa.RecordBatch], columns: list[str], most: int | None = None, part: str | None = None
) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Rows of sorted batches, list by list (the first column), lists of one row left out.

    Lists of which column ``part`` says that they are a part of one, and pieces of lists longer than
    ``most``, are told by True and come also if they have one row.
    """
    flag = columns.index(part) if part else None
    held: list[np.ndarray] | None = None
    begun = None  # the list of the last piece
    for batch in batches:
        got = [_values(batch.column(c)) for c in columns]
        held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
        cuts = np.flatnonzero(np.diff(held[0])) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.append(starts, len(held[0])))
        piece = held[0][starts[:-1]] == begun if begun is not None else np.zeros(len(starts) - 1, bool)
        if flag is not None:
            piece = piece | held[flag][starts[:-1]].astype(bool)
        for i in np.flatnonzero((sizes[:-1] > 1) | piece):
            yield bool(piece[i]), [x[starts[i] : starts[i] + sizes[i]] for x in held]
        held = [x[starts[-1] :] for x in held]
        if most and len(held[0]) > most:
            yield True, held
            begun, held = held[0][0], None
    if held is not None and len(held[0]):
        piece = begun is not None and held[0][0] == begun or flag is not None and bool(held[flag][0])
        if piece or len(held[0]) > 1:
            yield bool(piece), held


def _values(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _needed(n):
    """How many of the merged lists a partner has to share with a set of ``n`` shingles."""
    return 1 + n // 64


def _rows(h: list, a: list, b: list, c: list, needed: list) -> pa.RecordBatch:
    """Rows (h, a, b, c, needed); those of a pair (h 0) are summed up."""
    h, a, b, c, needed = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, a, b, c, needed))
    pair = np.flatnonzero(h == 0)
    pair = pair[np.lexsort((b[pair], a[pair]))]
    first = np.flatnonzero(np.append(True, (np.diff(a[pair]) != 0) | (np.diff(b[pair]) != 0))) if len(pair) else pair
    keep = np.concatenate([pair[first], np.flatnonzero(h != 0)])
    counts = c[keep]
    if len(pair):
        counts[: len(first)] = np.add.reduceat(c[pair], first)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h[keep], a[keep], b[keep], counts, needed[keep])], ["h", "a", "b", "c", "needed"])


def _merge_lists(merged: int, num: int, den: int, most: int = 1 << 16):
    """From postings (g, h, doc, n, weight, split) sorted by g: rows (h, a, b, c, needed).

    With h 0, a pair, the number of short lists that both are in, and how many they need. Otherwise the
    list h is long and holds document a; its documents are paired with a pivot, that counts for nothing.
    A g is a list, or a part of one if ``split``; a g of more than ``most`` comes in pieces. Each part and
    piece, however short, belongs to a long list, and c is 1 for its pivots, which others have to meet.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        held = 0
        for piece, (_, shingle, doc, n, weight, _) in _by_list(batches, ["g", "h", "doc", "n", "weight", "split"], most, "split"):
            k = len(doc)
            short = k <= merged and not piece
            if short:
                i, j = np.triu_indices(k, 1)
            else:
                rest, i, j = np.lexsort((doc, n, -weight)), [], []
                pivot = np.zeros(k, np.int64)
                while len(rest):
                    near = np.minimum(n[rest], n[rest[0]]) * den >= np.maximum(n[rest], n[rest[0]]) * num
                    near[0] = False
                    pivot[rest[0]] = piece or k > most
                    j.append(rest[near])
                    i.append(np.full(len(j[-1]), rest[0]))
                    near[0] = True
                    rest = rest[~near]
                i, j = np.concatenate(i), np.concatenate(j)
                none = np.zeros(k, np.int64)
                for x, new in zip(out, (np.where(shingle == 0, 1, shingle), doc, none, pivot, none), strict=True):
                    x.append(new)
                held += k
            fits = np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num
            i, j = i[fits], j[fits]
            none, low, high = np.zeros(len(i), np.int64), np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
            for x, new in zip(out, (none, low, high, none + short, _needed(np.minimum(n[i], n[j]))), strict=True):
                x.append(new)
            held += len(i)
            if held > 1 << 18:
                yield _rows(*out)
                out, held = [[], [], [], [], []], 0
        yield _rows(*out)

    return work


def _still_apart(num: int, den: int):
    """From rows (g, probe, doc, n, long, component, sketch) sorted by g: pairs of a probe and another document of the
    same g, of different components, that may link. The rows of one g are bounded.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, probe, *columns) in _by_list(batches, ["g", "probe", "doc", "n", "long", "component", "sketch"]):
            sides = []
            for which in (np.flatnonzero(probe), np.flatnonzero(~probe)):
                which = which[np.argsort(columns[1][which], kind="stable")]
                sides.append([x[which] for x in columns])
            (doc, n, long, component, sketch), (doc_2, n_2, long_2, component_2, sketch_2) = sides
            if not len(doc) or not len(doc_2):
                continue
            # Partners have at least num/den and at most den/num of a probe's shingles.
            first, last = np.searchsorted(n_2 * den, n * num, side="left"), np.searchsorted(n_2 * num, n * den, side="right")
            step = max(1, (1 << 19) // len(doc_2))
            for at in range(0, len(doc), step):
                rows = np.arange(at, min(at + step, len(doc)))
                cols = np.arange(first[rows].min(), last[rows].max())
                differ = np.bitwise_count(sketch[rows][:, None] ^ sketch_2[cols][None]).sum(2, dtype=np.int64)
                small, large = np.minimum(n[rows][:, None], n_2[cols][None]), np.maximum(n[rows][:, None], n_2[cols][None])
                total = small + large
                may = (total - differ) * (num + den) >= 2 * num * total
                may &= (component[rows][:, None] != component_2[cols][None]) & (small * den >= large * num)
                may &= np.minimum(long[rows][:, None], long_2[cols][None]) >= _needed(small)
                i, j = np.nonzero(may)
                i, j = doc[rows[i]], doc_2[cols[j]]
                if len(i):
                    both = np.unique(np.column_stack([np.minimum(i, j), np.maximum(i, j)]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return work


def _marked(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of hashed ids."""
    bit = F.pmod(F.xxhash64("doc"), F.lit(_MAP_BITS))
    rows = (
        ids.select(bit.alias("bit")).groupBy(F.expr("cast(bit div 64 as int)").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("set")).toPandas()
    )
    out = np.zeros(_MAP_BITS // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64)
    return out


def _marked_sets(k: int, marks: np.ndarray):
    """(doc, shingles) of the documents whose bit is marked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            chosen = np.flatnonzero(marks[bit >> 6] >> (bit & 63) & 1)
            part = batch.take(pa.array(chosen))
            for at in range(0, part.num_rows, 512):
                some = part.slice(at, 512)
                sets = [s.view(np.int64) for s in _sets(some.column("text"), k)]
                yield pa.RecordBatch.from_arrays([some.column("doc"), pa.array(sets, pa.list_(pa.int64()))], ["doc", "shingles"])

    return work


def _probe(num: int, den: int):
    """The pairs whose sets overlap enough, counted by binary search of the smaller set in the larger."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, good = batch.column("left"), batch.column("right"), []
            for i in range(batch.num_rows):
                x, y = (np.asarray(s[i].values).view(np.uint64) for s in (left, right))
                if len(x) > len(y):
                    x, y = y, x
                both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x) if len(x) else 0
                good.append(both > 0 and both * den >= num * (len(x) + len(y) - both))
            keep = np.flatnonzero(good)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    return work


def _pivot_pairs(lists: DataFrame, reps: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Rows like those of ``lists``: pairs of the pivots of lists that came in several parts."""
    pivots = lists.where("h <> 0 and c = 1").select("h", F.col("a").alias("doc")).join(reps.select("doc", "n", "weight"), "doc")
    rows = pivots.select(F.col("h").alias("g"), "h", "doc", "n", "weight", F.lit(False).alias("split")).distinct()
    met = rows.repartition("g").sortWithinPartitions("g").mapInArrow(_merge_lists(1, num, den, most), "h long, a long, b long, c long, needed long")
    return met.where("h = 0")


def _own_pivots(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Postings of each split list's pivots, one for each range of sizes, for the pieces that they are not in."""
    size = F.floor(F.log("n") / math.log(den / num)) if num < den else F.col("n")
    best = F.min_by(F.struct("doc", "n", "weight"), F.struct(-F.col("weight"), "n", "doc")).alias("p")
    chosen = postings.where("pieces is not null").groupBy("h", "pieces", size.alias("size")).agg(best).select("h", "pieces", "p.*")
    every = chosen.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    others = every.where(F.col("at") != F.pmod(F.xxhash64("doc"), F.col("pieces")))
    return others.select(F.xxhash64("h", "at").alias("g"), "h", "doc", "n", "weight", F.lit(True).alias("split"))


def _to_compare(lists: DataFrame, known: DataFrame, docs: DataFrame, block: int) -> DataFrame:
    """Rows (g, probe, ...) of documents that share a long list but not yet a component.

    A list's largest component is only compared with what is outside it. Both sides of the comparison
    come in blocks of bounded size, and every block of one side meets every block of the other.
    """
    long = lists.where("h <> 0").select("h", F.col("a").alias("doc")).distinct()
    long = materialize(long.join(known, "doc", "left").withColumn("component", F.coalesce("component", "doc")), "long-lists")
    sizes = long.groupBy("h", "component").agg(F.count("*").alias("k"))
    apart = sizes.groupBy("h").agg(
        F.count("*").alias("components"), F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("component", F.struct("k", "component")).alias("largest")
    ).where("components > 1")
    blocks = apart.select("h", "largest", F.ceil(F.col("n") / block).alias("blocks"), F.ceil((F.col("n") - F.col("most")) / block).alias("probes"))
    rows = spread_join(long, blocks, "h", "doc").where("largest is not null").join(docs, "doc")
    own = lambda of, seed: F.pmod(F.xxhash64("doc", F.lit(seed)), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    rest = ("doc", "n", "long", "component", "sketch")
    asked = rows.withColumns({"i": own("blocks", 0)}).withColumn("j", every("probes")).select(F.xxhash64("h", "i", "j").alias("g"), F.lit(False).alias("probe"), *rest)
    probes = rows.where("component <> largest").withColumns({"j": own("probes", 1)}).withColumn("i", every("blocks"))
    return asked.unionByName(probes.select(F.xxhash64("h", "i", "j").alias("g"), F.lit(True).alias("probe"), *rest))


def _links(docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, written down. ``reps`` has doc, n and sketch."""
    one = lambda x: reps.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    differ = F.expr("aggregate(zip_with(s_a, s_b, (x, y) -> bit_count(x ^ y)), 0, (acc, x) -> acc + x)")
    total = F.col("n_a") + F.col("n_b")
    may = (total - differ) * (num + den) >= 2 * num * total
    pairs = materialize(pairs.join(one("a"), "a").join(one("b"), "b").where(may).select("a", "b"), "candidates")
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    wanted = materialize(wanted, "candidate-ids")
    bit = F.pmod(F.xxhash64("doc"), F.lit(_MAP_BITS))
    texts = docs.select(F.col("doc_id").alias("doc"), "text").where("doc is not null").withColumn("bit", bit)
    sets = texts.mapInArrow(_marked_sets(k, _marked(wanted)), "doc long, shingles array<long>")
    with small_batches(docs.sparkSession):
        sets = materialize(sets.join(wanted, "doc", "left_semi").distinct(), "sets")
    both = pairs.join(sets.withColumnsRenamed({"doc": "a", "shingles": "left"}), "a").join(
        sets.withColumnsRenamed({"doc": "b", "shingles": "right"}), "b"
    )
    out = materialize(both.mapInArrow(_probe(num, den), "a long, b long"), "links")
    for done in (pairs, wanted, sets):
        discard(done)
    return out


def components(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, merged: int = 16, most: int = 1 << 16, piece: int | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Documents link if ``den`` times the intersection of their sets of ``k`` words is at least ``num``
    times the union. component_id is the smallest doc_id that links reach. ``merged``, ``most`` and
    ``piece`` (by default a share of all documents) decide how lists are dealt out, never the result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(spark):
        rows = materialize(
            texts.mapInArrow(_describe(k), "doc_id long, n long, digest string, frequent array<struct<shingle:long,n:long>>"), "sizes"
        )
    classes = materialize(
        rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(
            F.min("doc_id").alias("doc"), F.count("*").alias("weight")
        ),
        "classes",
    )
    often = rows.select(F.explode("frequent").alias("f")).groupBy("f.shingle").agg(F.sum("f.n").alias("n"))
    often = materialize(often.orderBy(F.desc("n"), "shingle").limit(_FREQUENT), "frequent")
    frequent = np.sort(often.select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(np.uint64))

    prefixes = texts.where("doc_id is not null").mapInArrow(
        _prefixes(k, frequent, num, den), "doc long, n long, prefix array<long>, sketch array<long>"
    )
    weights = classes.groupBy("doc").agg(F.max("weight").alias("weight"))
    with small_batches(spark):
        reps = materialize(prefixes.join(weights, "doc").dropDuplicates(["doc", "n", "sketch", "prefix"]), "prefixes")
    # Of the frequent shingles, which are no more than _FREQUENT, those whose lists are longer than a piece.
    share = weights.count() // _PIECES
    piece, block = piece or max(_LEAST_PIECE, share), min(max(_BLOCK[0], share), _BLOCK[1])
    pieces = F.broadcast(often.where(F.col("n") > piece).select(F.col("shingle").alias("h"), F.ceil(F.col("n") / piece).alias("pieces")))
    postings = reps.select(F.explode("prefix").alias("h"), "doc", "n", "weight").join(pieces, "h", "left")
    part = F.xxhash64("h", F.pmod(F.xxhash64("doc"), F.col("pieces")))
    own = _own_pivots(postings, num, den)
    postings = postings.select(F.coalesce(part, "h").alias("g"), "h", "doc", "n", "weight", F.col("pieces").isNotNull().alias("split")).unionByName(own)
    lists = materialize(
        postings.repartition("g").sortWithinPartitions("g").mapInArrow(
            _merge_lists(merged, num, den, most), "h long, a long, b long, c long, needed long"
        ),
        "lists",
    )
    in_long = materialize(lists.where("h <> 0").groupBy(F.col("a").alias("doc")).agg(F.count("*").alias("long")), "long")
    # A pair shares at most as many long lists as each of its documents is in.
    met = lists.where("h = 0").unionByName(_pivot_pairs(lists, reps, num, den, most))
    shared = met.where("a < b").groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("needed").alias("needed"))
    pairs = materialize(
        shared.join(in_long.withColumnsRenamed({"doc": "a", "long": "l_a"}), "a", "left")
        .join(in_long.withColumnsRenamed({"doc": "b", "long": "l_b"}), "b", "left")
        .where("c + least(coalesce(l_a, 0), coalesce(l_b, 0)) >= needed").select("a", "b", "c"),
        "pairs",
    )
    first = _links(texts, reps, pairs.select("a", "b"), k, num, den)

    known = connected_components(first).withColumnsRenamed({"node": "doc"})
    rows_of = in_long.join(reps.select("doc", "n", "sketch"), "doc")
    rest = (
        _to_compare(lists, known, rows_of, block).repartition("g").sortWithinPartitions("g")
        .mapInArrow(_still_apart(num, den), "a long, b long").where("a < b").distinct()
    )
    # Pairs that share a short list too were decided above.
    second = _links(texts, reps, rest.join(pairs, ["a", "b"], "left_anti"), k, num, den)

    found = connected_components(first.union(second)).withColumnsRenamed({"node": "doc"})
    by_class = classes.select("digest", "doc").join(found, "doc", "left").select("digest", F.coalesce("component", "doc").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return out.join(by_class, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that a smaller id's component holds; documents without an id stay."""
    found = components(docs, **options).where("doc_id is not null")
    others = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "duplicates")
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1")
    return kept if repeated.isEmpty() else kept.where("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.where("doc_id is null"))
