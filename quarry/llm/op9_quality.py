"""Quality rules with cross-document line frequency.

One pass over the texts gives each document's rule counts and its distinct normalised lines as
128-bit hashes. Lines are then counted over the distinct documents of each host, and lines found in
more documents than the host's limit are removed: ``line_limit``, or ``line_share`` of the host's
documents if that is more, as a line that a large host has in a few of its documents is no boilerplate.
A document that the rules fail, or that keeps less than ``min_left`` of its words, is rejected.

Normalised line: its words, A-Z in lower case, digits as 0, joined by one space.

Copies of a text are documents like any other. They are added up before their lines are counted, so a
large group of copies costs as much as one text.

Edges: a null or empty text has no words and fails; a null host is a host of its own; repeated rows
are separate documents; a null key is a key like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.common import map_arrow, materialise, table, with_row

LINE_LIMIT, LINE_SHARE, MIN_LEFT, WINDOW = 100, 0.001, 0.3, 5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: list[np.ndarray], row: np.ndarray) -> np.ndarray:
    """True where another entry of the same row has the same keys (all of them, first included)."""
    order = np.lexsort((*keys, row)) if len(row) else np.empty(0, np.int64)
    same = np.zeros(len(row) + 1, bool)
    same[1:-1] = True
    for k in (*keys, row):
        same[1:-1] &= k[order][1:] == k[order][:-1]
    out = np.zeros(len(row), bool)
    out[order] = same[1:] | same[:-1]
    return out


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The rule counts of every row of a slice, and its lines."""
    rows = len(offsets) - 1
    words = K.words_of(data, offsets)
    n_words = words.counts
    lead = (data & 0xC0) != 0x80
    solid = lead & ~K.SPACE[data]
    hashes = words.hashes()
    gram, valid = K.grams(hashes, words.first, WINDOW)
    at = np.flatnonzero(valid)
    row_of_word = np.repeat(np.arange(rows), n_words)
    twice = at[_repeated([gram[at]], row_of_word[at])]
    if len(twice):  # by another hash, too
        other = K.span_hash(words.hashes(K._R), twice, twice + WINDOW, K._R)
        twice = twice[_repeated([gram[twice], other], row_of_word[twice])]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    # lines: cut at \n; only lines with a word count
    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    begins = begins[begins < len(data)]
    line_row = np.searchsorted(offsets, begins, "right") - 1
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begins)], offsets[line_row + 1])
    first = np.searchsorted(words.starts, begins)
    last = np.searchsorted(words.starts, ends)
    held = last > first
    begins, ends, first, last, line_row = begins[held], ends[held], first[held], last[held], line_row[held]
    raw = [K.byte_hash(data, begins, ends, base) for base in (K._P, K._R)]
    order = np.lexsort((begins, *raw, line_row)) if len(begins) else np.empty(0, np.int64)
    again = np.zeros(len(begins), bool)
    again[order[1:]] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in (*raw, line_row)])
    folded_data = _FOLD[data]
    folded = [K.span_hash(K.byte_hash(folded_data, words.starts, words.ends, base), first, last, base) for base in (K._P, K._R)]
    texts = data.tobytes()
    names = b"".join([blake2b(texts[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
    return {
        "n_words": n_words, "word_chars": _per_row(solid, offsets), "n_symbols": _per_row(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_row[again], minlength=rows), "n_repeat_words": _per_row(covered, words.first),
        "line_row": line_row, "line_hash": folded, "line_words": last - first, "text_hash": np.frombuffer(names, "<i8").reshape(-1, 2),
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in K.slices(batch, "_text"):
        c = counts(data, offsets)
        order = np.lexsort((*c["line_hash"], c["line_row"]))
        row, size = c["line_row"][order], c["line_words"][order]
        keys = [k[order] for k in c["line_hash"]]
        new = np.ones(len(row), bool)
        new[1:] = ~np.logical_and.reduce([k[1:] == k[:-1] for k in (row, *keys)])
        at = np.flatnonzero(new)
        size = np.add.reduceat(size, at) if len(at) else size[:0]
        bounds = pa.array(np.searchsorted(row[at], np.arange(rows.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (keys[0][at].view(np.int64), keys[1][at].view(np.int64), size)]
        names = [pa.array(np.ascontiguousarray(c["text_hash"][:, i])) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*rows.columns[1:], *(pa.array(c[k], pa.int64()) for k in _COUNTS), *names, *lists], [*rows.schema.names[1:], *_COUNTS, "_t1", "_t2", "_l1", "_l2", "_sizes"])


def assess(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", line_limit: int = LINE_LIMIT, min_left: float = MIN_LEFT, line_share: float = LINE_SHARE) -> DataFrame:
    """(key, host, the five counts, n_left_words, base_failed, kept), one row per row of docs."""
    slim = with_row(docs.select(F.col(f"`{text}`").cast("string").alias("_text"), F.col(f"`{key}`").alias("_key"), F.col(f"`{host}`").alias("_host")))
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = f"_key {types['_key']}, _host {types['_host']}, _row bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", _t1 bigint, _t2 bigint, _l1 array<bigint>, _l2 array<bigint>, _sizes array<bigint>"
    stats = materialise(map_arrow(slim, _kernel, schema), "quality")
    # copies of a text in a host: one of them stands for all
    copies = materialise(stats.groupBy("_host", "_t1", "_t2").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_copies")), "quality-texts")
    limits = copies.groupBy(F.col("_host").alias("_lh")).agg(F.greatest(F.lit(float(line_limit)), F.sum("_copies") * F.lit(line_share)).alias("_limit"))
    one_each = stats.select("_row", "_host", "_l1", "_l2").join(copies.select("_first", "_copies"), F.col("_row") == F.col("_first"))
    counted = one_each.select("_host", "_copies", F.explode(F.arrays_zip("_l1", "_l2")).alias("_l")).groupBy("_host", F.col("_l._l1").alias("_c1"), F.col("_l._l2").alias("_c2")).agg(F.sum("_copies").alias("_n"))
    # the least of all limits drops most lines before the join
    common = counted.where(F.col("_n") > line_limit).join(limits, F.col("_host").eqNullSafe(F.col("_lh"))).where("_n > _limit").select("_host", "_c1", "_c2")
    common = materialise(common, "quality-common")
    lines = stats.select("_row", F.col("_host").alias("_h"), F.explode(F.arrays_zip("_l1", "_l2", "_sizes")).alias("_l")).select("_row", "_h", F.col("_l._l1").alias("_l1"), F.col("_l._l2").alias("_l2"), F.col("_l._sizes").alias("_size"))
    hit = lines.join(common, (F.col("_l1") == F.col("_c1")) & (F.col("_l2") == F.col("_c2")) & F.col("_h").eqNullSafe(F.col("_host")))
    gone = hit.groupBy("_row").agg(F.sum("_size").alias("_gone"))
    out = stats.drop("_l1", "_l2", "_sizes").join(gone, "_row", "left").withColumn("n_left_words", F.col("n_words") - F.coalesce("_gone", F.lit(0)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & (F.col("n_left_words") >= F.lit(min_left) * F.col("n_words"))
    return out.select(F.col("_key").alias(key), F.col("_host").alias(host), *_COUNTS, "n_left_words", failed.alias("base_failed"), kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT r, unnest(range(i, i + 5)) AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i) AS n FROM twice GROUP BY r),
l AS (SELECT r, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT r, source, unnest(string_split(t, chr(10))) AS line FROM d)),
dup AS (SELECT r, sum(n - 1) AS n FROM (SELECT r, line, count(*) AS n FROM l WHERE len(lw) > 0 GROUP BY r, line) GROUP BY r),
norm AS (SELECT r, source, regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS line, len(lw) AS size FROM l WHERE len(lw) > 0),
hosts AS (SELECT source, greatest(100.0, count(*) * 0.001) AS most FROM d GROUP BY source),
common AS (SELECT n.source, line FROM norm n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source GROUP BY n.source, line, most HAVING count(DISTINCT r) > most),
gone AS (SELECT n.r, sum(n.size) AS n FROM norm n JOIN common c ON n.source IS NOT DISTINCT FROM c.source AND n.line = c.line GROUP BY n.r),
a AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(w) - coalesce(gone.n, 0) AS BIGINT) AS n_left_words
  FROM w LEFT JOIN repeats USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_left_words >= 0.3 * n_words AS kept
FROM a
"""
