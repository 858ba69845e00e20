"""Language identification by Bayesian evidence fusion.

Three kinds of evidence are combined: the text itself (a naive Bayes model over byte
trigrams, fitted on labelled documents), what the page declares (its markup language, and
a language-like first path segment), and where it stands. What the last two say is not
given but counted: the texts' own posteriors are added up, by grouped aggregation over
all rows, per declared language, per segment and per host. A host's counts are smoothed
towards its domain's, those towards its address suffix's, and those towards the whole:
that is the prior. Every row is judged by the counts of all other rows: its own share is
taken out at every level and of every table, so no text speaks twice, and a host alone in
its domain learns from its suffix.

Defined results: a null or empty text leaves the other evidence to decide; missing
markup, address or host is no evidence; ties go to the first language in alphabetical
order; without labelled documents the language is null; texts of any length count whole;
repeated rows give repeated results, and speak for each other; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize
from .url_filters import with_parts

#: Labelled documents that the text model is fitted on, about, at most.
MAX_LABELLED = 20_000
BUCKETS = 1 << 16
#: Trigrams overlap, so their evidence counts for less than that of as many independent ones.
TEMPER = 0.2
#: Pseudo-rows of the wider level that a host, domain or suffix starts with.
PRIOR_ROWS = 5.0

#: Tables below this size are sent to all tasks; larger ones meet in a shuffle.
BROADCAST_BYTES = 32 << 20

_OPENS = re.compile(r"(?i)<(?:(script|style)\b|(!--))?")
_CLOSES = {"script": re.compile(r"(?i)</script\s*>"), "style": re.compile(r"(?i)</style\s*>"), "!--": re.compile("-->")}


def trigram_counts(data: bytes) -> np.ndarray:
    """Buckets of all byte trigrams of a lower-cased text; a space stands at both ends."""
    a = np.frombuffer(b" " + b" ".join(data.split()) + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.uint32)
    code = a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def plain(markup: str | None) -> str:
    """The text of a page: without tags, comments, scripts and styles, in one pass."""
    text, out, at, never = markup or "", [], 0, set()
    while (tag := text.find("<", at)) >= 0:
        out += text[at:tag], " "
        opened = _OPENS.match(text, tag)
        kind = (opened.group(1) or opened.group(2) or "").lower()
        closed = _CLOSES[kind].search(text, tag) if kind and kind not in never else None
        if kind and closed is None:
            never.add(kind)  # nothing further on closes it either
        at = closed.end() if closed else text.find(">", tag) + 1
        if not at:
            at = tag
            break
    return html.unescape("".join(out) + text[at:])


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def fit(labelled: DataFrame, max_labelled=MAX_LABELLED) -> tuple[list[str], np.ndarray]:
    """labelled(text, lang) to the languages and ln p(bucket | language) [BUCKETS, languages]."""
    rows = labelled.where(F.col("lang").isNotNull())
    total = rows.count()
    share = min(1.0, max_labelled / total) if total else 0.0
    rows = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, np.zeros(BUCKETS))
                seen[lang] += np.bincount(trigram_counts(_bytes(text)), minlength=BUCKETS)
        if seen:
            yield pa.RecordBatch.from_pydict({"lang": list(seen), "counts": pa.array([c.tobytes() for c in seen.values()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(c.as_py()) for c in table.column("counts"))
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([whole.tobytes()], pa.binary())})

    schema = "lang string, counts binary"
    found = rows.select("text", "lang").mapInArrow(count, schema).groupBy("lang").applyInArrow(add, schema).collect()
    found = sorted((r["lang"], np.frombuffer(r["counts"])) for r in found)
    if not found:
        return [], np.zeros((BUCKETS, 0), np.float32)
    counts = np.stack([c for _, c in found], 1) + 0.1
    return [lang for lang, _ in found], np.log(counts / counts.sum(0)).astype(np.float32)


def text_evidence(rows: DataFrame, languages: list[str], table: np.ndarray, is_markup: str, temper=TEMPER) -> DataFrame:
    """rows (with text, and a boolean column that says whether it is markup) without the
    text, and with ll array<double>: tempered log likelihoods, the best one 0."""
    at, markup = rows.columns.index("text"), rows.columns.index(is_markup)
    held = rows.sparkSession.sparkContext.broadcast(table)  # BUCKETS x languages
    keep = [k for k, c in enumerate(rows.columns) if c not in ("text", is_markup)]

    def run(batches):
        logs = held.value
        for whole in batches:
            for start in range(0, len(whole), 512):
                b = whole.slice(start, 512)
                out = []
                for text, page in zip(b.column(at).to_pylist(), b.column(markup).to_pylist(), strict=True):
                    grams = trigram_counts(_bytes(plain(text) if page else text))
                    ll = np.zeros(len(languages))
                    for k in range(0, len(grams), 1 << 20):
                        ll += logs[grams[k : k + (1 << 20)]].sum(0, dtype=np.float64)
                    out.append((temper * (ll - ll.max(initial=-np.inf))) if len(grams) > 1 and len(ll) else ll * 0)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(out, pa.list_(pa.float64()))], [*(b.schema.names[k] for k in keep), "ll"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    fields = [rows.schema.fields[k] for k in keep]
    return rows.mapInArrow(run, StructType([*fields, StructField("ll", ArrayType(DoubleType()))]))


def _softmax(logs: Column) -> Column:
    """Probabilities of an array of logs."""
    top = F.array_max(logs)
    return F.transform(F.array(F.transform(logs, lambda x: F.exp(x - top))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0]


def _counts(rows: DataFrame, keys: list[str], n: int, source="p") -> DataFrame:
    """Posteriors added up for each key, as arrays."""
    sums = [F.sum(F.get(source, F.lit(k))).alias(f"s{k}") for k in range(n)]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*(f"s{k}" for k in range(n))).alias("n"))


def _smoothed(counts: Column, wider: Column, rows=PRIOR_ROWS) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, wider, lambda x, w: (x + rows * w) / (total + rows))


def _sendable(table: DataFrame, n: int) -> DataFrame:
    """A table of so many counts a row, to be broadcast if it is small."""
    table = materialize(table, "counts")
    return F.broadcast(table) if table.count() * (8 * n + 128) <= BROADCAST_BYTES else table


def fuse(evidence: DataFrame, languages: list[str], prior_rows=PRIOR_ROWS) -> DataFrame:
    """evidence(.., host, declared, segment, ll) with lang, confidence and text_lang
    added. Nulls in host, declared and segment are no evidence."""
    n = len(languages)
    rows = evidence.withColumns(
        {
            "p": _softmax(F.col("ll")),
            "domain": F.substring_index("host", ".", -2),
            "suffix": F.substring_index("host", ".", -1),
        }
    )
    rows = materialize(rows, "evidence")
    named = lambda table, key, name: table.select(*key, F.col("n").alias(name))
    hosts = materialize(_counts(rows.where("host is not null"), ["host", "domain", "suffix"], n), "hosts")
    domains = materialize(_counts(hosts, ["domain", "suffix"], n, "n"), "domains")
    suffixes = _sendable(named(_counts(domains, ["suffix"], n, "n"), ["suffix"], "sn"), n)
    wider = _sendable(named(domains, ["domain", "suffix"], "dn").join(suffixes, "suffix"), 2 * n)
    levels = hosts.select(F.col("host").alias("_h"), "domain", "suffix", F.col("n").alias("hn")).join(wider, ["domain", "suffix"])
    joined = rows.drop("domain", "suffix").join(_sendable(levels.select("_h", "hn", "dn", "sn"), 3 * n), F.col("host") == F.col("_h"), "left")

    def sums(table: DataFrame, source: str) -> list[float]:
        return [x or 0.0 for x in _counts(table, [], n, source).first()["n"]]

    def of_others(counts: Column) -> Column:
        """Counts without the row's own share."""
        return F.zip_with(counts, "p", lambda x, p: F.greatest(x - p, F.lit(0.0)))

    whole = sums(rows, "p")
    flat = F.transform(of_others(F.array(*map(F.lit, whole))), lambda x: (x + 1.0) / (max(sum(whole) - 1, 0.0) + n))
    prior = reduce(lambda above, name: _smoothed(of_others(F.col(name)), above, prior_rows), ["sn", "dn", "hn"], flat)
    logs = F.zip_with("ll", F.transform(F.when(F.col("hn").isNotNull(), prior).otherwise(flat), lambda x: F.log(x)), lambda a, b: a + b)
    for column, name in (("declared", "ed"), ("segment", "es")):
        counts = materialize(_counts(rows.where(F.col(column).isNotNull()), [column], n), column)
        total = of_others(F.array(*map(F.lit, sums(counts, "n"))))
        joined = joined.join(_sendable(counts.select(F.col(column).alias(f"_{name}"), F.col("n").alias(name)), n), F.col(column) == F.col(f"_{name}"), "left")
        # ln p(value | language), smoothed by one pseudo-row
        rate = F.zip_with(of_others(F.col(name)), total, lambda x, t: F.log((x + 0.5) / (t + 1.0)))
        logs = F.when(F.col(name).isNotNull(), F.zip_with(logs, rate, lambda a, b: a + b)).otherwise(logs)
    out = joined.withColumn("post", _softmax(logs))
    names = F.array(*map(F.lit, languages))
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return out.select(
        *(c for c in evidence.columns if c != "ll"), best(F.col("post")).alias("lang"), F.round(F.array_max("post"), 6).alias("confidence"),
        F.when(F.array_min("ll") < 0, best(F.col("ll"))).alias("text_lang"),
    )


def identify(docs: DataFrame, pages: DataFrame | None = None, id_col="doc_id", text="text", source="source", label="lang", page_id="page_id") -> DataFrame:
    """(doc id, page id, lang, confidence, text_lang, declared, host) of every document
    and page; one of the two ids is null. A document's source is its host; documents
    declare nothing."""
    languages, table = fit(docs.select(F.col(text).alias("text"), F.col(label).alias("lang")))
    doc_type = docs.schema[id_col].dataType.simpleString()
    page_type = pages.schema[page_id].dataType.simpleString() if pages is not None else "long"
    null = lambda kind: F.lit(None).cast(kind)
    rows = docs.select(
        F.col(id_col).alias("d"), null(page_type).alias("g"), F.concat(F.lit("source:"), F.col(source)).alias("host"),
        null("string").alias("declared"), null("string").alias("segment"), F.col(text).alias("text"), F.lit(False).alias("markup"),
    )
    if pages is not None:
        own = with_parts(pages.select(F.col(page_id).alias("g"), "url", "html"))
        tag = F.lower(F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
        segment = ascii_lower(F.regexp_extract("path", r"^/([A-Za-z]{2,3})(?:/|$)", 1))
        none = lambda c: F.when(F.length(c) > 0, c)
        rows = rows.unionAll(own.select(null(doc_type).alias("d"), "g", none(F.col("host")), none(tag), none(segment), F.col("html"), F.lit(True)))
    if not languages:
        out = rows.select("d", "g", null("string").alias("lang"), null("double").alias("confidence"), null("string").alias("text_lang"), "declared", "host")
    else:
        out = fuse(text_evidence(rows, languages, table, "markup"), languages)
        out = out.select("d", "g", "lang", "confidence", "text_lang", "declared", "host")
    return out.withColumnRenamed("d", id_col).withColumnRenamed("g", page_id)
