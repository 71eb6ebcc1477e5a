"""The near-duplicate stage links by fingerprints first, and completes them by an exact join."""

import random

import corpus_pipeline
from quarry.llm import near_copies, op2_simhash
from quarry.llm.slabs import stored

RND = random.Random(11)
WORDS = [f"w{i}" for i in range(300)]


def texts():
    out = []
    for _ in range(40):
        base = RND.choices(WORDS, k=400)
        out.append(" ".join(base))
        for n in (1, 3, 12):
            near = list(base)
            for i in RND.sample(range(400), n):
                near[i] = RND.choice(WORDS)
            out.append(" ".join(near))
    return [*out, "", None, out[0]]


def parts(nodes, links):
    part = {n: n for n in nodes}

    def find(n):
        while part[n] != n:
            n = part[n]
        return n

    for a, b in links:
        part[find(a)] = find(b)
    return {frozenset(m for m in nodes if find(m) == find(n)) for n in nodes}


def test_stage_starts_from_fingerprints(spark, monkeypatch):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    seen, whole = [], op2_simhash.near_rows
    monkeypatch.setattr(op2_simhash, "near_rows", lambda *a, **k: seen.append(whole(*a, **k)) or seen[-1])
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert seen and seen[0].count() > 0
    assert kept == {r["doc_id"] for r in near_copies.dedup(docs).collect()}


def test_rows_within_three_bits(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    held = stored(spark.createDataFrame(rows, "doc_id bigint, text string"), "text", "doc_id", ["doc_id", "text"])
    from quarry.llm.slabs import slabs

    def marks(batches):
        import pyarrow as pa

        for _, meta, data, offsets in slabs(batches):
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([meta.column(2)]), pa.array(op2_simhash.fingerprints(data, offsets, 5).view("int64"))], ["_row", "_fp"])

    marked = held.blobs.mapInArrow(marks, "_row bigint, _fp bigint").collect()
    fp = {r["_row"]: r["_fp"] & (1 << 64) - 1 for r in marked}
    brute = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    got = [(r["a"], r["b"]) for r in op2_simhash.near_rows(held, spark.createDataFrame([(r,) for r in fp], "_row bigint"), 5).collect()]
    assert brute and parts(fp, got) == parts(fp, brute)
