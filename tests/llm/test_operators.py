"""The corpus operators against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import components, kernels as K, op1_language, op2_simhash, op3_suffixes, op4_substrings, op5_lines, op6_topk, op7_pii, op8_mixing, op9_quality, op10_sentencepiece

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, size string"


def corpus(n=160, seed=3):
    """Small texts with copies, near copies, shared passages, repeats, nulls and odd rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéö") for _ in range(r.randint(1, 7))) for _ in range(150)]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, texts = sentence(70), []
    for i in range(n):
        kind = i % 10
        if kind == 0 and texts:
            t = r.choice(texts) or ""
        elif kind == 1 and texts:
            w = WORD.findall(r.choice(texts) or "") or ["x"]
            w[r.randrange(len(w))] = "zzz"
            t = " ".join(w)
        elif kind == 2:
            t = sentence(r.randint(0, 30)) + "\n" + passage + " " + sentence(20)
        elif kind == 3:
            t = "na " * r.randint(1, 60) + sentence(5) + "\n\nna na\tna\n" + "na na\tna"
        elif kind == 4:
            t = f"{sentence(10)} me.{i}@mail{i}.example.com 10.0.0.{i} 999.1.1.1 4539 1488 0343 6467 +1 (555) 123-45{i % 100:02d} {sentence(4)} ###"
        else:
            t = "\n".join(sentence(r.randint(1, 60)) for _ in range(r.randint(1, 6)))
        texts.append(t)
    texts[5], texts[6], texts[7] = None, "", " \n\t "
    rows = [(i, t, "en" if t and "é" not in t else "fr", f"s{i % 5}", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return rows + [(3, texts[3], None, None, None, None, None), (None, sentence(80), None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def words(t):
    return WORD.findall(t or "")


def key(r):
    return (r is None, r or 0)


def test_words_kernel(rows):
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.string())], ["t"])
    got = []
    for _, data, offsets in K.slices(batch, "t", 500):
        w = K.words_of(data, offsets)
        got += [[data[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [words(r[1]) for r in rows]


def test_minimisers_cover_every_window(rows):
    data, offsets = K.text_buffers(pa.array([r[1] for r in rows]))
    w = K.words_of(data, offsets)
    gram, valid = K.grams(w.hashes(), w.first, 4)
    found = set(K.minimisers(gram, valid, w.first, 10).tolist())
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        assert all(found & set(range(p, p + 10)) for p in range(a, b - 13 + 1))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {g["node"]: g["component"] for g in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    wanted = {x: find(x) for x in parent}
    single = {x for x in wanted if sum(v == wanted[x] for v in wanted.values()) == 1}
    assert got == {x: c for x, c in wanted.items() if x not in single}


def test_simhash(docs, rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    prints = []
    for r in rows:
        w = words((r[1] or "").translate(low))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum((2 * sum(h >> b & 1 for h in hashed) > len(hashed)) << b for b in range(64)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    wanted = sorted(((r[0], f"{p:016x}", min((k for k in least[find(i)] if k is not None), default=None)) for i, (r, p) in enumerate(zip(rows, prints, strict=True))), key=str)
    got = sorted(((g["doc_id"], g["fingerprint"], g["component_id"]) for g in op2_simhash.groups(docs).collect()), key=str)
    assert got == wanted
    assert op2_simhash.dedup(docs).columns == docs.columns


def test_simhash_large_posting():
    r = np.random.default_rng(0)
    base = np.uint64(0xABCDEF0123456789)
    fps = np.unique(base ^ (r.integers(0, 1 << 24, 9000, np.uint64)))
    links = op2_simhash._forest_by_probes(fps, 3)
    assert len(links) < len(fps) and all((a ^ b).bit_count() <= 3 for a, b in links[:200])
    small = fps[:300]

    def parts(pairs):
        parent = {int(x): int(x) for x in small}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        return len({find(x) for x in parent})

    brute = [(int(a), int(b)) for a in small for b in small if a < b and int(a ^ b).bit_count() <= 3]
    assert parts(op2_simhash.forest(small)) == parts(op2_simhash._forest_by_probes(np.sort(small), 3)) == parts(brute)


def repeated(rows, n):
    seen = collections.Counter()
    split = [words(r[1]) for r in rows]
    for w in split:
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return [{j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)} for w in split], split


@pytest.mark.parametrize("window", [35, 12])
def test_substrings(docs, rows, window):
    gone, split = repeated(rows, window)
    wanted = sorted((str(r[0]), len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()) for r, g, w in zip(rows, gone, split, strict=True))
    got = sorted((str(g["doc_id"]), g["n_words"], g["n_removed"], g["kept_sha256"]) for g in op4_substrings.remove(docs, window=window, seed=min(8, window - 4)).collect())
    assert got == wanted


def test_suffixes(docs, rows):
    gone, split = repeated(rows, 50)
    wanted = sorted((str(r[0]), len(w), sorted(g)) for r, g, w in zip(rows, gone, split, strict=True))
    got = sorted((str(g["doc_id"]), g["n_words"], sorted(x for s in g["spans"] for x in range(s["start"], s["end"]))) for g in op3_suffixes.spans(docs).collect())
    assert got == wanted


def test_lines(docs, rows):
    gone, seen = collections.defaultdict(list), []
    for n, r in sorted(enumerate(rows), key=lambda x: (key(x[1][0]), x[0])):
        for i, line in enumerate((r[1] or "").split("\n")):
            s = frozenset(words(line))
            if s:
                if any(len(s & t) >= 0.8 * len(s | t) - 1e-9 for t in seen):
                    gone[n].append(i)
                seen.append(s)
    # equal keys: either of the two equal rows may be the first
    wanted = sorted((str(r[0]), len((r[1] or "").split("\n")), gone[n]) for n, r in enumerate(rows) if r[0] != 3)
    got = sorted((str(g["doc_id"]), g["n_lines"], list(g["removed"])) for g in op5_lines.report(docs).collect() if g["doc_id"] != 3)
    assert got == wanted
    kept = {r["doc_id"]: r["text"] for r in op5_lines.dedup(docs).collect() if r["doc_id"] not in (3, None)}
    for n, r in enumerate(rows):
        if r[0] not in (3, None):
            left = [x for i, x in enumerate((r[1] or "").split("\n")) if i not in gone[n]]
            assert (r[0] in kept) == (bool(words("\n".join(left))) or not words(r[1]))
            if r[0] in kept:
                assert kept[r[0]] == (None if r[1] is None else "\n".join(left))


def best_of(data, k=20):
    """Brute force: (query id, rank, id, score) of every row whose id is divisible by 20."""
    ints = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(data) if v and None not in v and all(map(math.isfinite, v))]
    out = []
    for n, i, q in ints:
        if i is not None and i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for m, j, v in ints if m != n and len(v) == len(q))
            out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found_by(frame, **options):
    got = op6_topk.search(frame, F.col("vec_id") % 20 == 0, **options).collect()
    return sorted(((g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in got), key=str)


@pytest.mark.parametrize("kind", ["dense", "sparse", "negative", "large", "huge"])
def test_topk(spark, kind):
    r = np.random.default_rng(0)
    vectors = np.round(r.normal(0, 0.2, (400, 8)), 2)
    if kind == "sparse":
        vectors[r.random(vectors.shape) < 0.8] = 0
        vectors = np.abs(vectors)
    if kind == "negative":
        vectors = -np.abs(vectors)
        vectors[::3] *= -1
    if kind == "large":
        vectors[7], vectors[40, 0] = 1e7 * vectors[7], 3e6
    if kind == "huge":
        vectors[7], vectors[40, 0] = 1e13 * vectors[7], 3e2
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    data[3], data[4], data[5] = (3, None), (4, [1.0, None] + [0.0] * 6), (5, [float("nan")] * 8)
    # ids that repeat, no id, other lengths, nothing
    data += [(20, data[9][1]), (20, data[20][1]), (None, data[20][1]), (None, data[9][1]), (60, [0.5, 1.0]), (80, [0.25, 3.0]), (100, []), (140, [0.0] * 8)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    assert found_by(frame, shard=70, block=8) == best_of(data)


def test_topk_exact_types_and_overflow(spark):
    ones = np.ones((2, 4))
    assert [op6_topk.exact_type(ones * 2.0**a, ones * 2.0**b) for a, b in ((5, 5), (12, 12), (30, 25), (40, 40))] == [np.float32, np.float64, np.int64, object]
    frame = spark.createDataFrame([(20, [1e30, 0.0]), (1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        op6_topk.search(frame, F.col("vec_id") % 20 == 0).collect()


def test_topk_splits_terms():
    r = np.random.default_rng(1)
    vectors = np.where(r.random((300, 30)) < 0.15, np.floor(r.exponential(20, (300, 30))), 0)
    vectors[:, 0] = np.where(r.random(300) < 0.3, 900.0, 0)
    ids = np.stack((np.zeros(300, np.int64), np.arange(300)), 1)
    shard = op6_topk.Postings(vectors, ids, np.arange(300), np.float64)
    for own in range(0, 300, 7):
        scores = vectors @ vectors[own]
        order = sorted((-s, i) for i, s in enumerate(scores) if i != own)[:20]
        for floor in (None, -order[-1][0], -order[4][0]):
            at, got = op6_topk.maxscore(shard, vectors[own], own, 20, floor)
            wanted = [(i, -s) for s, i in order if floor is None or -s >= floor]
            assert list(zip(at.tolist(), got.tolist(), strict=True))[: len(wanted)] == wanted


def test_pii(docs, rows):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(t):
        digits = lambda s: re.sub(r"[^0-9]", "", s)
        out = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(digits(m[0])) <= 19 and op7_pii.luhn(digits(m[0]))]
        return out + [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(digits(m[0])) <= 15]

    odd = ["a@b.c@d.e", "@@x@y.z.", "1.2.3.4.5.6.7.8", "é1.2.3.4 +12 34-5678 ", "x" * 50 + "@a.b-c..d", "256.1.1.1.1", "4539-1488-0343-6467 4539 1488 0343 6468", "a+1@b.co 00.01.002.0255"]
    for t in odd + [r[1] or "" for r in rows]:
        assert sorted(op7_pii.base_spans(t)) == sorted(brute(t)), t
    got = op7_pii.find(docs, op7_pii.fit(docs)).collect()
    assert len(got) == len(rows)
    by_id = {g["doc_id"]: g for g in got}
    for r in rows[:-2]:
        spans = brute(r[1] or "")
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        g = by_id[r[0]]
        assert (g["n_email"], g["n_ip"], g["n_card"], g["n_phone"]) == tuple(sum(s[0] == k for s in spans) for k in op7_pii.BASE) and g["base_sha256"] == digest
        assert set(filter(None, g["spans"].split(","))) >= {f"{k}:{a}:{b}" for k, a, b in spans}
    assert op7_pii.redact("mail me@x.org now", "email:5:13") == "mail [email] now"


def test_boosting_holds_out():
    r = np.random.default_rng(0)
    x = r.normal(0, 1, (2000, 5))
    x[:, 0] = r.integers(0, 2, 2000)
    y = (x[:, 1] > 0.2) & (x[:, 2] < 0.5)
    held = np.arange(2000) % 2 == 0
    model = op7_pii.boost(x, y, held)
    score = model.score(x[held])
    assert ((score > 0.5) == y[held]).mean() > 0.97 and set(model.thresholds) == {"email", "ip"}


def filled(sizes, weights, share=1.5, cap=2.0):
    total, stopped = share * sum(sizes.values()), {s for s in sizes if not sizes[s]}
    while True:
        free = [s for s in sizes if s not in stopped]
        level = (total - sum(cap * sizes[s] for s in stopped)) / sum(weights[s] for s in free)
        above = {s for s in free if level * weights[s] > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in stopped else level * weights[s] for s in sizes}
        stopped |= above


def test_mixing(docs, rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(s for s in sizes if s is not None) + [None]
    targets = filled(dict(sizes), dict(zip(order, [5, 2, 1, 5, 2, 1], strict=False)))
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6
    plan = lambda d: op8_mixing.plan(d, op8_mixing.cyclic(), shards=8).collect()
    got = plan(docs)
    taken, shards = collections.Counter(), collections.Counter()
    for g in got:
        assert g["source_size"] == sizes[g["source"]] and abs(g["target"] - targets[g["source"]]) < 1e-6 and 0 <= g["taken"] <= 2 * g["size"]
        taken[g["source"]] += g["taken"]
        shards.update(c["shard"] for c in g["copies"])
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes) and set(shards) == set(range(8)) and max(shards.values()) - min(shards.values()) <= 12
    plain = lambda rows: sorted(str({k: v for k, v in g.asDict().items() if k != "_row"}) for g in rows)
    assert plain(plan(docs)) == plain(got) == plain(plan(docs.repartition(5)))
    mixed = op8_mixing.mix(docs, op8_mixing.tempered, shards=8)
    assert mixed.columns == docs.columns
    found = collections.Counter(r["text"] for r in mixed.collect())
    assert set(found) == {r[1] for r in rows if words(r[1])}


def test_mixing_copies_of_one_row(spark):
    rows = [(1, "a b c", "s")] * 500 + [(i, "d e", "t") for i in range(20)] + [(2, "", "t"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op8_mixing.plan(docs, op8_mixing.cyclic(), shards=4).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(g["taken"] - g["target"]) <= 1 and g["over"] <= 0 for g in got) and len(got) == 3
    assert op8_mixing.mix(docs, op8_mixing.tempered, shards=4).count() == 500 + 2 * 20


def test_splitting_tree():
    quota = np.array([0, 7, 1000, 123, 5])
    tree = lambda: op8_mixing.splitting_tree(quota, np.ones(7), 1)
    assert (tree().sum(0) == quota).all() and tree().sum(1).max() - tree().sum(1).min() <= 3 and (tree() == tree()).all()


def test_large_draws_are_hypergeometric(monkeypatch):
    rng = lambda: np.random.Generator(np.random.Philox(key=[1, 2]))
    have, wanted = np.array([3, 0, 400, 90]), 200
    plain = np.array([op8_mixing.draw(g, have, wanted) for g in [rng()] for _ in range(3000)])
    monkeypatch.setattr(op8_mixing, "LARGE", 10)
    g = rng()
    own = np.array([op8_mixing.draw(g, have, wanted) for _ in range(3000)])
    assert (own.sum(1) == wanted).all() and (own <= have).all()
    assert np.abs(own.mean(0) - wanted * have / have.sum()).max() < 0.5 and np.abs(own.std(0) - plain.std(0)).max() < 0.3
    monkeypatch.undo()
    big = op8_mixing.draw(rng(), np.array([6 * 10**11, 10**12, 5]), 8 * 10**11)
    assert big.sum() == 8 * 10**11 and abs(big[0] - 3 * 10**11) < 10**7


def test_shares_over_groups_of_sources(spark, monkeypatch):
    monkeypatch.setattr(op8_mixing, "TOP", 8)
    quota = spark.createDataFrame([(f"s{i}", i % 9) for i in range(200)] + [(None, 40)], "source string, n long")
    got = op8_mixing.shares(quota, 30, 3).collect()
    by_source, by_shard = collections.Counter(), collections.Counter()
    for g in got:
        by_source[g["source"]] += g["n"]
        by_shard[g["shard"]] += g["n"]
    assert by_source == collections.Counter({f"s{i}": i % 9 for i in range(200) if i % 9} | {None: 40})
    assert set(by_shard) <= set(range(30)) and max(by_shard.values()) - min(by_shard.values()) <= 4


def test_quality(docs, rows):
    got = {(g["doc_id"], g["source"]): g for g in op9_quality.assess(docs, line_limit=2).collect()}
    assert op9_quality.assess(docs).count() == len(rows)
    texts = [(r[3], r[1] or "") for r in rows]  # copies count
    fold = lambda line: " ".join(re.sub("[0-9]", "0", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)) for w in words(line))
    common = collections.Counter((s, line) for s, t in texts for line in {fold(x) for x in t.split("\n")} if line)
    for r in rows[:-2]:
        t, w = r[1] or "", words(r[1])
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        left = sum(len(words(x)) for x in t.split("\n") if common[r[3], fold(x)] <= 2)
        g = got[r[0], r[3]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed)
        assert g["n_left_words"] == left and g["kept"] == (not failed and left >= 0.3 * len(w))


def test_language_held_out(spark):
    r = random.Random(0)
    tongues = {"en": "the of and ing tion er ed".split(), "de": "der und sch ung ein ich en".split(), "fr": "le la eau é ment tion ou".split()}
    text = lambda k, n: " ".join("".join(r.choice(tongues[k]) for _ in range(r.randint(1, 3))) for _ in range(n))
    train = [(i, text(k, 40), k, f"h{i % 3}") for i in range(300) for k in [list(tongues)[i % 3]]]
    test = [(i, text(k, 15), None, f"h{i % 3}") for i in range(300, 360) for k in [list(tongues)[i % 3]]] + [(990, None, None, None), (991, "", None, "h0"), (992, "漢字仮名交じり文です" * 20, None, "h1"), (993, "12 34 !!", "en", None)]
    schema = "doc_id long, text string, lang string, source string"
    model = op1_language.fit(spark.createDataFrame(train, schema), "text", "lang")
    got = {g["doc_id"]: g for g in op1_language.identify(spark.createDataFrame(test, schema), model, declared=F.col("lang"), host=F.col("source")).collect()}
    assert sum(got[i]["language"] == list(tongues)[i % 3] and got[i]["kept"] for i in range(300, 360)) >= 58
    assert not any(got[i]["kept"] for i in (990, 991, 992, 993)) and got[992]["language"] == "und"


def test_sentencepiece(docs, rows):
    import sentencepiece

    v = op10_sentencepiece.load()
    library = sentencepiece.SentencePieceProcessor(model_file=op10_sentencepiece.MODEL)
    texts = [r[1] for r in rows] + ["  the  cat\n\n sat ", "日本語😀 x\t\ty", "a" * 300 + " " + "ab" * 100, "\n", "   "]
    data, offsets = K.text_buffers(pa.array(texts))
    ids, bounds = op10_sentencepiece.encode(v, data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == library.encode([t or "" for t in texts])
    back, at = op10_sentencepiece.decode(v, ids, bounds)
    assert back.tobytes() == data.tobytes() and (at == offsets).all()
    encoded = op10_sentencepiece.tokens(docs, v)
    assert encoded.where("not round_trip").count() == 0 and encoded.count() == len(rows)
    assert sorted(map(str, (r["text"] for r in op10_sentencepiece.texts(encoded, v).collect()))) == sorted(str(r[1] or "") for r in rows)


def test_viterbi_is_optimal():
    r = random.Random(2)
    pieces = ["<unk>", *"abc▁", "ab", "bc", "abc", "ca", "▁a", "▁ab", "cab"]
    scores = [0.0] + [-r.uniform(1, 5) for _ in pieces[1:]]
    v = op10_sentencepiece.vocabulary(pieces, scores, [2] + [1] * (len(pieces) - 1), True)
    floor = min(scores[1:]) - 10
    table = dict(zip(pieces[1:], scores[1:], strict=True))

    def best(s):
        if not s:
            return 0.0
        return max((table.get(s[:k], floor if k == 1 else -1e9) + best(s[k:]) for k in range(1, min(len(s), 4) + 1)))

    for _ in range(30):
        word = "".join(r.choice("abcd") for _ in range(8))
        ids, sizes = op10_sentencepiece.viterbi(v, np.array([[ord(c) for c in word]], np.int64))
        got = sum(scores[i] if i >= 0 else floor for i in ids[0, : sizes[0]])
        assert abs(got - best(word)) < 1e-3


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "none.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    none = spark.read.parquet(path)
    assert op2_simhash.groups(none).count() == op4_substrings.remove(none).count() == op5_lines.report(none).count() == op3_suffixes.spans(none).count() == 0
    assert op9_quality.assess(none).count() == op7_pii.find(none, op7_pii.fit(none)).count() == op1_language.of_documents(none).count() == 0
    assert op8_mixing.plan(none, op8_mixing.cyclic()).count() == op8_mixing.mix(none, op8_mixing.tempered).count() == 0
    assert op2_simhash.dedup(none).count() == op5_lines.dedup(none).count() == op1_language.keep_known(none).count() == 0
    assert op10_sentencepiece.tokens(none, op10_sentencepiece.load()).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op6_topk.search(vectors, F.lit(True)).count() == 0


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{i}"))
        after = spark.read.parquet(str(tmp_path / f"stage{i}"))
        if i < 4:
            assert after.columns == docs.columns, name
        assert after.count() > 0
        docs = after
    assert docs.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_near_dedup_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    fresh = lambda k: [f"w{r.randrange(100000)}" for _ in range(k)]
    boiler, texts = fresh(30), []
    for i in range(40):
        base = fresh(r.randint(20, 150)) + (boiler if i % 3 == 0 else [])
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 5):  # similarity falls from about 0.95 to below 0.8
            w = list(base)
            for at in r.sample(range(len(w)), edits):
                w[at] = fresh(1)[0]
            texts.append(" ".join(w))
    core = fresh(120)
    texts += [" ".join(core[:i] + fresh(1) + core[i + 1 :]) for i in range(0, 120, 3)]  # one large group
    texts += [texts[0], texts[0].upper(), "one two", "One  two", "one", "", " ", None]
    r.shuffle(texts)
    sets = []
    for t in texts:
        w = words((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    path = str(tmp_path / "near")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet(path), None)
    assert sorted(x["doc_id"] for x in got.collect()) == sorted({find(i) for i in range(len(texts))})


def test_pii_adds_disguised_spans(spark):
    r = random.Random(5)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    card = lambda n: op7_pii._checked("4" + digits(n - 1))
    say = lambda: " ".join(r.choice(["the", "river", "old", "house", "green", "walks", "again"]) for _ in range(r.randint(2, 6)))
    texts = []
    for _ in range(300):
        base = [f"{r.choice('abc')}{digits(2)}.x@mail{digits(1)}.example.com", ".".join(str(r.randint(0, 255)) for _ in range(4)), f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", card(16)]
        texts.append(f"{say()} " + f" {say()} ".join(base) + f" {say()} id={digits(9)} {say()}")
    plants = [("email", "kim (AT) mail (DOT) example (DOT) com"), ("email", "kim[at]mail.example.org"), ("ip", "10 . 20 . 3 . 77"), ("phone", "1 (555) 123-4567"), ("card", "3782 822463 10005")]
    others = ["look (at) this. Then", "id=123456789", "10 . 20 . 3 . 777"]
    marked = [f"the old house {p} again walks" for _, p in plants] + [f"the old house {p} again" for p in others]
    rows = list(enumerate(texts + marked))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {g["doc_id"]: g["spans"] for g in op7_pii.find(frame, op7_pii.fit(frame)).collect()}
    assert [got[len(texts) + i] for i in range(len(plants))] == [f"{k}:14:{14 + len(p)}" for k, p in plants]
    assert [got[len(texts) + len(plants) + i] for i in range(len(others))] == [""] * len(others)


def test_suffixes_with_overlapping_partial_copies(spark, tmp_path):
    r = random.Random(9)
    fresh = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    rows = []
    for trial in range(400):
        passage, after = fresh(50 + trial % 8), fresh(49)
        shift = r.randint(1, 5)
        # the third text shares 49 words with the first, beyond the end of the passage
        copies = (fresh(60) + passage + after, fresh(60) + passage + fresh(60), fresh(60) + passage[-(49 - shift) :] + after[:shift] + fresh(60))
        rows += [(3 * trial + i, " ".join(c)) for i, c in enumerate(copies)]
    path = str(tmp_path / "partial")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
    gone, _ = repeated(rows, 50)
    got = {g["doc_id"]: {x for s in g["spans"] for x in range(s["start"], s["end"])} for g in op3_suffixes.spans(spark.read.parquet(path)).collect()}
    assert got == {n: g for (n, _), g in zip(rows, gone, strict=True)}
