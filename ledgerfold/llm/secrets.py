"""Secret scans by an incremental ledger of blobs.

Every version of every path is content-addressed. The ledger says which blob was scanned by which
version of which rule, and what it found; a run scans only blob and rule-version pairs that the ledger
lacks, one copy of each blob, appends what it did to the ledger, and joins the findings back to all
paths. A blob that a third of all rows share is aggregated before the shuffle and read once; its narrow
rows are dealt to many tasks when they meet its findings.

The findings of a path are those of the asked versions of the rules, whatever run made them and in
whatever order; those of other versions stay in the ledger and are not reported. A run that is repeated
or that was cut short adds equal rows or none, and changes nothing.

A null text is the empty blob. Rows that repeat an id keep a row each. Spans count code points, end
exclusive. Without rows, the results are empty. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm._store import exists, materialize, spread_join
from ledgerfold.llm._text import slices

Span = tuple[int, int]

# The patterns that the scan has to find.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----")


def _assign(text: str) -> Iterator[Span]:
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                yield m.span()


def _access(text: str) -> Iterator[Span]:
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield m.span()


def _plain(pattern: re.Pattern, cue: str) -> Callable[[str], Iterator[Span]]:
    return lambda text: (m.span() for m in pattern.finditer(text)) if cue in text else iter(())


#: Rule, version, scanner; findings at one place are listed in this order.
RULES: tuple[tuple[str, int, Callable[[str], Iterator[Span]]], ...] = (
    ("assign", 1, _assign),
    ("access", 1, _access),
    ("hex", 1, _plain(_HEX, "")),
    ("github", 1, _plain(_GITHUB, "gh")),
    ("jwt", 1, _plain(_JWT, "eyJ")),
    ("private_key", 1, _plain(_PRIVATE, "-----BEGIN")),
)
BASE = ("assign", "access", "hex")

_RULE = pa.struct([("rule", pa.string()), ("version", pa.int32())])
_SPAN = pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
#: A row for each blob that a run scanned: the rules that it used, and what they found.
LEDGER = "blob string, rules array<struct<rule:string,version:int>>, spans array<struct<kind:string,version:int,start:long,end:long>>"


def blob(text: str = "text") -> Column:
    """The content address of a text."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, without rows where nothing has been written yet."""
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)


def _asked(rules) -> Column:
    pair = lambda name, version: F.struct(F.lit(name).alias("rule"), F.lit(version).alias("version"))
    return F.array(*(pair(name, version) for name, version, _ in rules))


def _scanner(rules):
    by_name = {(name, version): (k, scan) for k, (name, version, scan) in enumerate(rules)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text, todo in zip(batch.column("text").to_pylist(), batch.column("todo").to_pylist(), strict=True):
                hits = []
                for x in todo:
                    k, one = by_name[x["rule"], x["version"]]
                    hits += [(s, k, e, x) for s, e in one(text or "")]
                hits.sort(key=lambda h: h[:3])
                found.append([{"kind": x["rule"], "version": x["version"], "start": s, "end": e} for s, _, e, x in hits])
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), batch.column("todo").cast(pa.list_(_RULE)), pa.array(found, pa.list_(_SPAN))], ["blob", "rules", "spans"]
            )

    return scan


def addresses(docs: DataFrame) -> DataFrame:
    """(doc_id, blob) of every row, written down: a narrow table in the place of the texts."""
    return materialize(docs.select("doc_id", blob().alias("blob")), "blobs")


def scan_unseen(docs: DataFrame, ledger: DataFrame, rules=RULES, addressed: DataFrame | None = None) -> DataFrame:
    """Scan what the ledger lacks: a ledger row (blob, rules, spans) for each blob that some rule has not seen.

    ``docs`` has doc_id and text, one row for each version of a path; ``addressed`` comes from ``addresses``.
    """
    addressed = addresses(docs) if addressed is None else addressed
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    nothing = F.expr("cast(array() as array<struct<rule:string,version:int>>)")
    todo = (
        addressed.groupBy("blob").agg(F.min("doc_id").alias("reader")).join(seen, "blob", "left")
        .withColumn("todo", F.array_except(_asked(rules), F.coalesce("seen", nothing))).where(F.size("todo") > 0).drop("seen")
    )
    d, t = docs.select("doc_id", "text", blob().alias("blob")).alias("d"), todo.alias("t")
    to_read = d.join(t, (F.col("d.blob") == F.col("t.blob")) & F.col("d.doc_id").eqNullSafe(F.col("t.reader")))
    return to_read.select("d.blob", "d.text", "t.todo").mapInArrow(_scanner(rules), LEDGER)


def at_paths(addressed: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """Findings of all versions of all paths: (doc_id, blob, spans), spans null where a blob has none.

    ``addressed`` comes from ``addresses``. Spans are by start, then by the place of their rule in ``rules``, then by
    end. A blob that a run read twice, or that several runs scanned by the same rules, counts once.
    """
    kinds = F.array(*(F.lit(name) for name, _, _ in rules))
    asked = _asked(rules)
    mine = F.filter("spans", lambda x: F.array_contains(asked, F.struct(x["kind"].alias("rule"), x["version"].alias("version"))))
    in_order = F.transform(mine, lambda x: F.struct(x["start"].alias("start"), F.array_position(kinds, x["kind"]).alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))
    some = (
        ledger.where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(in_order)))).alias("spans"))
        .select("blob", F.transform("spans", lambda x: x.dropFields("place")).alias("spans")).where(F.size("spans") > 0)
    )
    return spread_join(addressed, some, "blob", "doc_id").select("doc_id", "blob", "spans")


def run(docs: DataFrame, path: str, rules=RULES) -> DataFrame:
    """One run over ``docs``: scan what the ledger at ``path`` lacks, append it, and report from the ledger."""
    spark = docs.sparkSession
    addressed = addresses(docs)
    scan_unseen(docs, read_ledger(spark, path), rules, addressed).write.mode("append").parquet(path)
    return at_paths(addressed, read_ledger(spark, path), rules)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def digest(found: DataFrame, kinds: tuple[str, ...] = BASE) -> DataFrame:
    """Counts by kind, base_sha256, spans and n_found (all kinds) of (doc_id, spans) rows."""
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:long,end:long,kind:string>>)"))
    base = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in kinds]
    return found.select(
        "doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"), F.size(spans).cast("long").alias("n_found")
    )
