"""Language identification by Bayesian evidence fusion.

The likelihood of a text under each language comes from hashed character trigrams. It is fused with
the language that the markup declares, with the suffix of the address, and with a prior of the host
that is smoothed towards its domain and that towards all rows. The tables of this evidence come from
grouped aggregation over all rows, by the language that the text alone suggests.

The trigram model is fitted on a bounded sample: at most ``per_language`` labelled rows for each label
that has ``least_rows``, equal rows being one. No label is left out for being one of many; the model takes
a quarter of a megabyte for each, and languages are few. Everything else covers all rows. Texts are
scored whole and once: the scores are written down with the columns that stay.

A text without letters has no likelihood and is rejected (``und``), as is one that no model
explains better than chance by ``margin`` nats a trigram, or whose best language stays under
``least`` probability. Null evidence says nothing. Rows that repeat an id keep a row each. Without
labelled rows everything is rejected; without rows the result is empty. Other columns stay, and may have
any names but those that begin with an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.llm._store import materialize, small_batches

_BINS = 1 << 16
_BLOCK = 1 << 19
#: Trigrams that count in full; the rest of a longer text only sharpens the mean.
_FULL = 120
_CHANCE = -float(np.log(_BINS))

_FOLD = np.full(128, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_p: np.ndarray  # trigram bin by language


def _bins(text: str) -> np.ndarray:
    """Bins of the trigrams that hold two letters or more; other ASCII counts as one kind of gap."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = cp < 128
    cp = np.where(ascii_, _FOLD[np.where(ascii_, cp, 0)], cp)
    if len(cp) < 3:
        cp = np.concatenate([[np.uint32(32)], cp, [np.uint32(32)]])
    if len(cp) < 3:
        return np.zeros(0, np.int64)
    gap = cp == 32
    full = (gap[:-2].view(np.int8) + gap[1:-1] + gap[2:]) < 2
    x = cp[:-2] * np.uint32(2654435761) + cp[1:-1] * np.uint32(2246822519) + cp[2:] * np.uint32(3266489917)
    x ^= x >> np.uint32(15)
    return (x[full] * np.uint32(668265263) >> np.uint32(16)).astype(np.int64)


def _pieces(text: str) -> Iterator[str]:
    for at in range(0, max(1, len(text)), _BLOCK):
        yield text[at : at + _BLOCK + 2]


def fit(labelled: DataFrame, per_language: int = 2000, least_rows: int = 3) -> Model:
    """Trigram model of (doc_id, text, lang) rows; the sample is the first rows of each label by a hash of id and text."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    hashed = known.withColumn("_row", F.xxhash64("doc_id", "text"))
    # The hashes of a label's different rows fall into 1024 buckets; as many buckets as the sample needs are
    # drawn, however many rows the label has, and of these the first rows are taken.
    bucket = F.shiftright(F.pmod("_row", F.lit(1 << 30)), 20)
    counts = hashed.groupBy("lang", bucket.alias("_bucket")).agg(F.count("*").alias("n"), F.approx_count_distinct("_row").alias("d"))
    along = Window.partitionBy("lang").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumns({"_before": F.coalesce(F.sum("d").over(along), F.lit(0)), "_all": F.sum("n").over(Window.partitionBy("lang"))})
    bounds = needed.where((F.col("_before") < 1.5 * per_language) & (F.col("_all") >= least_rows)).groupBy("lang").agg(F.max("_bucket").alias("_last"))
    drawn = hashed.join(F.broadcast(bounds), "lang").where(bucket <= F.col("_last"))  # one row for each label is broadcast
    first = Window.partitionBy("lang").orderBy("_row")
    wanted = drawn.select("lang", "_row").distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language)
    sample = drawn.join(wanted.select("lang", "_row"), ["lang", "_row"]).dropDuplicates(["lang", "_row"]).select("lang", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                n = np.zeros(_BINS, np.int64)
                for text in texts:
                    for piece in _pieces(text):
                        n += np.bincount(_bins(piece), minlength=_BINS)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "bin": at, "n": n[at]})

    bins = sample.mapInPandas(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    with small_batches(labelled.sparkSession):
        got = bins.toPandas()  # at most _BINS rows for each language
    names = tuple(sorted(got["lang"].unique()))
    table = np.full((_BINS, len(names)), 0.1, np.float64)
    for k, name in enumerate(names):
        own = got[got["lang"] == name]
        table[own["bin"].to_numpy(), k] += own["n"].to_numpy()
    return Model(names, np.log(table / table.sum(0, keepdims=True)).astype(np.float32))


def log_likelihoods(text: Column, model: Model) -> Column:
    """Array of double: the number of trigrams, then the mean log-likelihood by language."""
    width = len(model.languages)

    @F.arrow_udf("array<double>")
    def score(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            out = []
            for at in range(0, len(texts), 512):
                for text in texts.slice(at, 512).to_pylist():
                    n, total = 0, np.zeros(width)
                    for piece in _pieces(text or ""):
                        bins = _bins(piece)
                        n += len(bins)
                        total += model.log_p[bins].sum(0, dtype=np.float64)
                    out.append(np.concatenate([[n], total / max(n, 1)]))
            yield pa.array(out, pa.list_(pa.float64()))

    return score(text)


def _log_share(n: Column, total: Column, prior: Column, weight: float) -> Column:
    """Log of a share, smoothed towards a prior that counts as ``weight`` rows."""
    return F.log((n + weight * prior) / (total + weight))


def identify(
    rows: DataFrame,
    model: Model,
    text: str = "text",
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    domain: Column | None = None,
    margin: float = 1.0,
    least: float = 0.5,
    weight: float = 20.0,
    stay: tuple[str, ...] | None = None,
) -> DataFrame:
    """Adds ``language`` (``und`` if rejected), ``probability`` and ``accepted`` to the rows.

    All columns stay, or those that ``stay`` names; columns of the three names are replaced.
    """
    rows = rows.drop("language", "probability", "accepted")
    kept = [c for c in rows.columns if stay is None or c in stay]
    if not model.languages:
        return rows.select(*kept).withColumns({"language": F.lit("und"), "probability": F.lit(0.0), "accepted": F.lit(False)})
    nothing = F.lit(None).cast("string")
    evidence = {"_declared": declared, "_suffix": suffix, "_host": host, "_domain": domain}
    evidence = {k: nothing if v is None else v.cast("string") for k, v in evidence.items()}
    keys = list(evidence)
    key = F.sha2(F.to_json(F.struct(*(F.col(k) for k in keys)), {"ignoreNullFields": "false"}), 256)
    with small_batches(rows.sparkSession):
        scored = materialize(rows.select(*kept, *(v.alias(k) for k, v in evidence.items()), log_likelihoods(F.col(text), model).alias("_ll")), "scored")
    scored = scored.withColumns({"_n": F.get("_ll", 0), "_mean": F.slice("_ll", 2, len(model.languages))})

    best = F.array_max("_mean")
    seen = scored.where(F.col("_n") > 0).select(*keys, (F.array_position("_mean", best) - 1).cast("int").alias("l"))
    # One row for each combination of evidence and language, not for each document.
    groups = materialize(
        seen.groupBy(*keys, "l").agg(F.count("*").alias("n")).unionByName(
            scored.select(*keys).distinct().withColumns({"l": F.lit(-1), "n": F.lit(0).cast("long")})
        ),
        "evidence",
    )
    counted = groups.where("l >= 0")
    every = counted.groupBy("l").agg(F.sum("n").alias("n")).toPandas().set_index("l")["n"]  # one row for each language
    share = np.array([every.get(k, 0) + 1.0 for k in range(len(model.languages))])
    share /= share.sum()
    langs = F.explode(F.array(*(F.struct(F.lit(k).alias("l"), F.lit(float(p)).alias("p_all")) for k, p in enumerate(share))))
    combos = groups.select(*keys).distinct().select(*keys, langs.alias("_l")).select(*keys, "_l.*")

    def joined(left: DataFrame, by: list[str], name: str) -> DataFrame:
        """Adds the rows of each combination of ``by`` as ``name``; null values match nothing and count 0."""
        n = counted.groupBy(*by).agg(F.sum("n").alias(name))
        return left.join(n, by, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))

    table = combos
    for by, name in (
        (["l"], "n_l"), (["_domain", "l"], "n_dl"), (["_domain"], "n_d"), (["_host", "l"], "n_hl"), (["_host"], "n_h"),
        (["_declared", "l"], "n_cl"), (["_declared"], "n_c"), (["_suffix", "l"], "n_sl"), (["_suffix"], "n_s"),
    ):
        table = joined(table, by, name)
    total = F.lit(float(every.sum()))
    smooth = lambda n, of, p: (F.col(n) + weight * p) / (F.col(of) + weight)
    p_domain = smooth("n_dl", "n_d", F.col("p_all"))
    prior = F.log(smooth("n_hl", "n_h", p_domain))
    said = lambda c, n, of: F.when(
        F.col(c).isNotNull(), _log_share(F.col(n), F.col("n_l"), (F.col(of) + 1) / (total + 1), weight)
    ).otherwise(0.0)
    fused = table.withColumn("e", prior + said("_declared", "n_cl", "n_c") + said("_suffix", "n_sl", "n_s"))
    fused = materialize(
        fused.groupBy(key.alias("_key")).agg(F.array_sort(F.collect_list(F.struct("l", "e"))).alias("_e")), "fused"
    )  # a row for each combination; Spark broadcasts it only under its threshold

    with_text = F.least(F.col("_n"), F.lit(float(_FULL)))
    logit = F.zip_with("_mean", F.col("_e.e"), lambda m, e: m * with_text + e)
    top = F.array_max("_logit")
    sure = 1 / F.aggregate("_logit", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    place = F.array_position("_logit", top)
    name = F.element_at(F.array(*(F.lit(x) for x in model.languages)), place.cast("int"))
    fits = F.element_at("_mean", place.cast("int")) >= _CHANCE + margin
    accepted = (F.col("_n") > 0) & fits & (sure >= least)
    out = scored.withColumn("_key", key).join(fused, "_key", "left").withColumn("_logit", logit)
    return out.withColumns({"probability": F.round(sure, 6), "accepted": F.coalesce(accepted, F.lit(False))}).select(
        *kept, F.when(F.col("accepted"), name).otherwise("und").alias("language"), "probability", "accepted"
    )


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents (text, lang, source and any other columns) whose language is accepted."""
    rows = docs.select("text", F.col("lang").alias("said"), F.col("source").alias("host"), F.struct("*").alias("row"))
    found = identify(rows, model, declared=F.col("said"), host=F.col("host"), stay=("row",))
    return found.where("accepted").select("row.*")


def markup_language(html: str) -> Column:
    """The language subtag that a page's html element declares, or null."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)


def address_suffix(url: str) -> Column:
    """The language-like first segment of the path, or the top-level domain."""
    segment = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/]+/([a-zA-Z]{2})(?:/|$)", 1))
    tld = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/:?#]*\.([a-zA-Z]+)(?:[:/?#]|$)", 1))
    return F.when(segment != "", F.concat(F.lit("/"), segment)).when(tld != "", tld)


def host_of(url: str) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/:?#]+)", 1))
    return F.when(found != "", found)


def domain_of(url: str) -> Column:
    found = F.regexp_extract(host_of(url), r"([^.]+\.[^.]+)$", 1)
    return F.when(found != "", found)
