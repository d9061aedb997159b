"""Secret scans over an incremental blob ledger.

Every version of a text is a blob named by its sha-256.  The ledger holds a row for each blob and rule version
that has been scanned, with or without findings.  An update scans only pairs of blob and rule version that the
ledger lacks, appends them, and joins the findings back to all documents (paths) that hold the blob; a copy is
never scanned twice, and a new rule version scans old blobs with that rule alone.

Spans are code points, end exclusive.  Defined results: a null text is the empty text; null, repeated and
conflicting ids each give a row as they come; ties in start go by the order of kinds; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevein.llm.common import settle, shared_dir

LEDGER = "blob binary, rule string, spans array<struct<start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()  # lower-case strings, one of which any match has

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules and, last, one that the ledger adds.
BASE = (
    Rule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    # A run of hex digits under 24 always fails, so only long runs are asked for.
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, ("private key-----",)),)
RULES = BASE + ADDED


def find(rule: Rule, compiled: re.Pattern, text: str, low: str) -> list[tuple[int, int]]:
    if rule.hints and not any(h in low for h in rule.hints):
        return []
    return [m.span() for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]


def _scan(rules: tuple[Rule, ...]):
    kinds = (pa.binary(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.key: (r, re.compile(r.pattern)) for r in rules}
        for batch in batches:
            out: list[tuple] = []
            for blob, text, todo in zip(*(batch.column(c).to_pylist() for c in ("blob", "text", "todo")), strict=True):
                low = text.lower()
                out += [(blob, key, [{"start": a, "end": b} for a, b in find(*compiled[key], text, low)]) for key in todo]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["blob", "rule", "spans"])

    return scan


def blob_of(docs: DataFrame):
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, text, todo: each blob once, with the rule versions that it hasn't been scanned by."""
    blobs = docs.select(blob_of(docs).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        return blobs.dropDuplicates(["blob"]).withColumn("todo", every)
    seen = ledger.filter(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    done = seen.filter(F.size("seen") == len(rules))
    fresh = blobs.join(done, "blob", "left_anti").dropDuplicates(["blob"])
    return fresh.join(seen, "blob", "left").select("blob", "text", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))


def update(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``ledger_path`` lacks, append it, and return the whole ledger."""
    spark = docs.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    ledger = spark.read.schema(LEDGER).parquet(ledger_path) if there else None
    fresh = unseen(docs, ledger, rules).mapInArrow(_scan(rules), LEDGER)
    # The rows to append are complete before the append begins, so a retry can't read its own output.
    (settle(fresh) if there else fresh).write.mode("append").option("compression", "zstd").parquet(ledger_path)
    return spark.read.schema(LEDGER).parquet(ledger_path)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, found: array of (start, order, kind, end) in order, for every document."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(i).alias("order"), F.lit(r.kind).alias("kind")))])
    hits = (
        ledger.filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
        .select("blob", order[F.col("rule")].alias("r"), F.explode("spans").alias("s"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct("s.start", "r.order", "r.kind", "s.end"))).alias("found"))
    )
    return docs.select("doc_id", blob_of(docs).alias("blob")).join(hits, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:long,order:int,kind:string,end:long>>")))


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document; without a path the ledger is new."""
    path = ledger_path or f"{shared_dir(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    found = findings(docs, update(docs, path, rules), rules)
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _spans_sql(kind: str, pattern: str, keep: str) -> str:
    """Spans from the pieces between the matches."""
    return f"""list_filter(list_transform(range(1, len(m_{kind}) + 1), lambda i: {{
      'start': list_sum([len(x) for x in p_{kind}[1:i]])::BIGINT + coalesce(list_sum([len(x) for x in m_{kind}[1:i - 1]]), 0)::BIGINT,
      'ord': {['assign', 'access', 'hex', 'private_key'].index(kind)}, 'kind': '{kind}',
      'end': list_sum([len(x) for x in p_{kind}[1:i]])::BIGINT + list_sum([len(x) for x in m_{kind}[1:i]])::BIGINT,
      'keep': {keep}}}), lambda s: s.keep)"""


_CASES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = rf"""({_CASES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PRIVATE = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
_KINDS = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{24,}", "private_key": _PRIVATE}
_KEEP = {"assign": "len(g_assign[i]) >= 6", "access": "len(m_access[i]) >= 20", "hex": "true", "private_key": "true"}
_JOIN = "array_to_string(list_transform({}, lambda s: s.kind || ':' || s.start || ':' || s.\"end\"), ',')"

#: The same report without a ledger, for DuckDB.
REPORT_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT doc_id, regexp_extract_all(t, '{_ASSIGN}', 2) AS g_assign,
  {', '.join(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS p_{k}" for k, p in _KINDS.items())} FROM texts),
found AS (SELECT doc_id, {', '.join(f"{_spans_sql(k, p, _KEEP[k])} AS s_{k}" for k, p in _KINDS.items())} FROM cut),
lists AS (SELECT *, list_sort(s_assign || s_access || s_hex) AS base, list_sort(s_assign || s_access || s_hex || s_private_key) AS spans_all FROM found)
SELECT doc_id, len(s_assign)::BIGINT AS n_assign, len(s_access)::BIGINT AS n_access, len(s_hex)::BIGINT AS n_hex,
  sha256(coalesce({_JOIN.format('base')}, '')) AS base_sha256, coalesce({_JOIN.format('spans_all')}, '') AS spans
FROM lists
"""
