"""Language identification by Bayesian evidence fusion.

The posterior of a language joins four kinds of evidence:

* text: a naive Bayes likelihood over hashed byte trigrams (A-Z folded, everything that is not a
  letter one space), tempered, as neighbouring trigrams are not independent;
* declared markup language: how often a declaration goes with a language, from grouped counts;
* address suffix and host: priors smoothed down a hierarchy, all data -> suffix -> host. Each level
  is one grouped aggregation of the languages that the text alone gives, and shrinks to the level
  above with a fixed weight.

An extra hypothesis, "und", spreads evenly over all trigrams and takes texts in no known language.
A document is rejected if "und" wins, if the winner is below ``min_confidence``, or if it has no
letters.

The trigram model is fitted on a bounded sample of labelled rows: ``sample_rows`` (5,000) of each
label, or all that it has, are expected among its different texts, chosen by a hash of the text. So every
label is fitted at every size, and rows that repeat count once. The model holds 256 KB for each language,
however many rows there are; likelihoods, counts and priors cover every row.

Edges: null or empty texts have no letters and are rejected (their language is the prior's);
null declarations, suffixes and hosts are evidence classes of their own; repeated rows count as
they stand; null keys stay null; an empty table, or one without any label, gives und for every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.common import map_arrow, materialise, table, trimmed
from quarry.llm.slabs import numbered

SAMPLE_ROWS, CODES, HELD = 5_000, 1 << 16, 32
TEMPER, MIN_CONFIDENCE = 0.3, 0.6
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, valid) of the trigram at every byte; trigrams of spaces alone are not counted."""
    n = len(data)
    if n < 3:
        return np.zeros(0, np.uint16), np.zeros(0, bool)
    b = _FOLD[data].astype(np.uint32)
    code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    valid = (b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))
    edge = offsets[1:-1]
    for back in (1, 2):
        cut = edge - back
        valid[cut[(cut >= 0) & (cut < n - 2)]] = False
    return (code >> np.uint32(16)).astype(np.uint16), valid


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for label, seen in total.items():
            hit = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(seen[hit], pa.int64())], ["label", "code", "n"])
        total.clear()

    for batch in batches:
        labels = batch.column(1).to_pylist()
        at = 0
        for rows, data, offsets in K.slices(batch, "_text"):
            code, valid = trigrams(data, offsets)
            for i in range(rows.num_rows):
                part = slice(int(offsets[i]), max(int(offsets[i]), int(offsets[i + 1]) - 2))
                seen = np.bincount(code[part][valid[part]], minlength=CODES)
                total[labels[at + i]] = total.get(labels[at + i], 0) + seen
                if len(total) > HELD:  # tables of a few labels at a time
                    yield from out()
            at += rows.num_rows
    yield from out()


def _logs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(label, log probabilities) from (label, list of (code, n))."""
    for label, codes, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
        seen = np.full(CODES, 0.05)
        seen[codes.values.to_numpy()] += n.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([label], pa.string()), pa.array([np.log(seen / seen.sum()).astype("<f4").tobytes()], pa.binary())], ["label", "logs"])


def sample(labelled: DataFrame, text: str, label: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(_text, _label): about sample_rows different texts of each label, or all of them."""
    rows = labelled.select(F.col(f"`{text}`").alias("_text"), F.col(f"`{label}`").cast("string").alias("_label")).where("_text is not null and _label is not null")
    hashed = rows.withColumn("_h", F.xxhash64("_text", "_label"))
    shares = hashed.groupBy("_label").agg(F.approx_count_distinct("_h").alias("_n")).select(F.col("_label").alias("_l"), F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("_n")).alias("_share"))
    # a row for each label, of which the model holds 256 KB each; a join by label would put a label in one task
    chosen = hashed.join(F.broadcast(shares), F.col("_label") == F.col("_l")).where(F.pmod("_h", F.lit(1 << 30)) < F.col("_share") * F.lit(float(1 << 30)))
    return chosen.select("_text", "_label", "_h").dropDuplicates(["_label", "_h"]).drop("_h")


def fit(labelled: DataFrame, text: str, label: str, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of every trigram code, from a bounded sample."""
    counted = sample(labelled, text, label, sample_rows).mapInArrow(trimmed(_count), "label string, code int, n bigint")
    sums = counted.groupBy("label", "code").agg(F.sum("n").alias("n"))  # CODES rows for each label at most
    lists = sums.groupBy("label").agg(F.collect_list(F.struct("code", "n")).alias("c")).select("label", "c.code", "c.n")
    found = sorted((r["label"], r["logs"]) for r in map_arrow(lists, _logs, "label string, logs binary").collect())  # 256 KB for each language
    return [x for x, _ in found], np.array([np.frombuffer(x, "<f4") for _, x in found]).reshape(-1, CODES)


def _score_kernel(model: Broadcast):
    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        logs = model.value
        for rows, data, offsets in K.slices(batch, "_text"):
            code, valid = trigrams(data, offsets)
            code = code[valid]
            bounds = np.concatenate(([0], np.cumsum(valid)))[np.minimum(offsets, len(valid))]
            n = np.diff(bounds)
            scores = np.zeros((len(logs), rows.num_rows))
            held = np.flatnonzero(n)
            if len(held):
                for i, row in enumerate(logs):
                    scores[i, held] = np.add.reduceat(row[code], bounds[:-1][held], dtype=np.float64)
            flat = pa.array(np.ascontiguousarray(scores.T).ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * len(logs)), flat)
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(n, pa.int64()), lists], [*rows.schema.names[1:], "_grams", "_logs"])

    return kernel


def _argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)) - 1


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", key: str = "doc_id", declared: Column | None = None, suffix: Column | None = None,
    host: Column | None = None, temper: float = TEMPER, min_confidence: float = MIN_CONFIDENCE, rows: str | None = None,
) -> DataFrame:
    """(key, language, confidence, text_language, kept), one row per row of docs."""
    languages, logs = model
    names = [*languages, "und"]
    logs = np.vstack([logs, np.full((1, CODES), -np.log(CODES), np.float32)])
    none = F.lit(None).cast("string")
    numbers = F.monotonically_increasing_id() if rows is None else F.col(rows)
    slim = docs.select(F.col(text).alias("_text"), F.col(key).alias("_key"), *[(none if c is None else c.cast("string")).alias(a) for c, a in ((declared, "_declared"), (suffix, "_suffix"), (host, "_host"))], numbers.alias("_row"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "_text")
    scored = materialise(map_arrow(slim, _score_kernel(docs.sparkSession.sparkContext.broadcast(logs)), f"{kept}, _grams bigint, _logs array<double>").withColumn("_first", F.when(F.col("_grams") > 0, _argmax(F.col("_logs")).cast("bigint"))), "language")
    size = len(names)
    # one aggregation, rolled up: host -> suffix -> all; declarations apart
    counts = scored.where("_first is not null").groupBy("_suffix", "_host", "_declared", "_first").agg(F.count(F.lit(1)).alias("_n"))
    counts = materialise(counts, "language-counts")

    def levels(*by: str) -> DataFrame:
        each = counts.groupBy(*by, "_first").agg(F.sum("_n").alias("_n"))
        found = each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_first", "_n"))).alias("_m"), F.sum("_n").alias("_t"))
        return found.select(*by, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_m", i.cast("bigint")), F.lit(0))).alias("_c"), "_t")

    world = levels().first()
    total = float(world["_t"] or 0)
    floor = [1e-3] * size
    prior = [((world["_c"][i] or 0) + f) / (total + sum(floor)) for i, f in enumerate(floor)]
    base = F.array(*[F.lit(float(p)) for p in prior])

    def shrink(c: str, t: str, above: Column, weight: float) -> Column:
        return F.coalesce(F.zip_with(c, above, lambda n, p: (n + F.lit(weight) * p) / (F.col(t) + F.lit(weight))), above)

    by_suffix = levels("_suffix").select(F.col("_suffix").alias("_s"), shrink("_c", "_t", base, 50.0).alias("_of_suffix"))
    by_host = levels("_suffix", "_host").select(F.col("_suffix").alias("_hs"), F.col("_host").alias("_hh"), F.col("_c").alias("_hc"), F.col("_t").alias("_ht"))
    by_host = by_host.join(by_suffix, F.col("_hs").eqNullSafe(F.col("_s"))).select("_hs", "_hh", shrink("_hc", "_ht", F.col("_of_suffix"), 20.0).alias("_of_host"))
    # P(declaration | language) relative to the declaration's overall rate
    by_declared = levels("_declared").select(F.col("_declared").alias("_d"), F.zip_with("_c", base, lambda n, p: F.log((n + F.lit(5.0) * p) / (F.col("_t") + F.lit(5.0)) / p)).alias("_of_declared"))
    out = scored.join(by_host, F.col("_suffix").eqNullSafe(F.col("_hs")) & F.col("_host").eqNullSafe(F.col("_hh")), "left").join(by_declared, F.col("_declared").eqNullSafe(F.col("_d")), "left")
    zero = F.array_repeat(F.lit(0.0), size)
    joint = F.zip_with(F.transform("_logs", lambda x: x * F.lit(temper)), F.transform(F.coalesce("_of_host", base), lambda p: F.log(p)), lambda a, b: a + b)
    joint = F.zip_with(joint, F.coalesce("_of_declared", zero), lambda a, b: a + b)
    out = out.withColumn("_joint", joint).withColumn("_top", F.array_max("_joint"))
    confidence = F.lit(1.0) / F.aggregate(F.transform("_joint", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda a, b: a + b)
    label = F.array(*[F.lit(x) for x in names])
    language = F.element_at(label, (_argmax(F.col("_joint")) + 1).cast("int"))
    out = out.select(F.col("_key").alias(key), language.alias("language"), confidence.alias("confidence"), F.element_at(label, (F.col("_first") + 1).cast("int")).alias("text_language"), "_grams", "_row")
    keep = (F.col("_grams") > 0) & (F.col("language") != "und") & (F.col("confidence") >= min_confidence)
    return out.withColumn("kept", keep).drop("_grams")


def of_documents(docs: DataFrame) -> DataFrame:
    """lang is the label of the sample and the declared language of every row; text_language is what the text
    alone gives, and the tests hold labels out."""
    return identify(docs, fit(docs, "text", "lang"), declared=F.col("lang"), host=F.col("source"))


def keep_known(docs: DataFrame, text: str = "text", key: str = "doc_id", label: str = "lang", host: str = "source") -> DataFrame:
    """docs without those that are rejected; columns stay. The rejected rows are the smaller side of
    the join, broadcast where their file is small enough for the session's threshold."""
    base = numbered(docs, text, key, docs.columns)
    named = lambda c: F.col(f"c{docs.columns.index(c)}")
    found = identify(base, fit(docs, text, label), "_text", "_key", declared=named(label), host=named(host), rows="_row")
    gone = materialise(found.where(~F.coalesce("kept", F.lit(False))).select(F.col("_row").alias("_gone")), "language-gone")
    return base.join(gone, F.col("_row") == F.col("_gone"), "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_documents(table(spark, sf_dir, "documents")).drop("_row")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for web pages, with all evidence: markup, address suffix and host."""
    docs = table(spark, sf_dir, "documents")
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&[a-z#0-9]+;", " ")
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    page = table(spark, sf_dir, "pages").select("page_id", plain.alias("text"), F.lower(F.nullif(F.regexp_extract("html", r'(?i)<html[^>]*\blang="([a-z]+)', 1), F.lit(""))).alias("declared"), host.alias("host"))
    found = identify(page, fit(docs, "text", "lang"), key="page_id", declared=F.col("declared"), suffix=F.element_at(F.split("host", r"\."), -1), host=F.col("host"))
    return found.drop("_row")
