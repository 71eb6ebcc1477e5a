"""Beyond the easy cases: colliding words, moved splits, hot postings, many labels, library and SQL as judges."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import kernels as K, near_copies, op1_language, op3_suffixes, op4_substrings, op5_lines, op7_pii, op9_quality, op10_sentencepiece, registry, set_join
from quarry.llm.slabs import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def thue_morse(n, swap=False):
    a, b = ("b", "a") if swap else ("a", "b")
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


def written(spark, tmp_path, rows, schema, parts=3, name="d"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def covered(rows, n):
    seen, split = collections.Counter(), [words(t) for _, t in rows]
    for w in split:
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return [{j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)} for w in split]


@pytest.fixture(scope="module")
def hard():
    """Texts that differ in words which any polynomial modulo 2**64 takes for equal, and very long ones."""
    r = random.Random(4)
    fresh = lambda k: [f"v{r.randrange(10**6)}" for _ in range(k)]
    rows, body = [], fresh(60)
    for n in (512, 1024, 2048, 8192):
        for swap in (False, True):
            rows.append((len(rows), " ".join([*body[:34], thue_morse(n, swap), *body[34:]])))
            rows.append((len(rows), thue_morse(n, swap)))
    for swap in (False, True):  # the same of words
        rows.append((len(rows), " ".join("xy"[c == "b"] for c in thue_morse(128, swap)) + " " + " ".join(fresh(5))))
    rows.append((len(rows), " ".join(fresh(30_000) + body)))
    rows.append((len(rows), "q" * 300_000 + " " + " ".join(body)))
    rows.append((len(rows), "\n".join(" ".join(fresh(3)) for _ in range(5000))))
    return rows + [(len(rows), None), (len(rows) + 1, ""), (None, " ".join(body))]


def test_hashes_tell_structured_spans_apart():
    for n in (128, 512, 1024, 4096):
        text = np.frombuffer((thue_morse(n) + " " + thue_morse(n, True)).encode(), np.uint8)
        for base in (K._P, K._Q, K._R):
            assert len(set(K.words_of(text, np.array([0, len(text)])).hashes(base).tolist())) == 2
        both = np.frombuffer((thue_morse(n) + thue_morse(n, True)).encode(), np.uint8).astype(np.uint64)
        assert len(set(K.span_hash(both, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
    a, b = (np.array([random.Random(s).randrange(2**61 - 1) for _ in range(500)], np.uint64) for s in (1, 2))
    assert K._product(a, b).tolist() == [int(x) * int(y) % (2**61 - 1) for x, y in zip(a, b, strict=True)]


def test_substrings_and_suffixes_of_hard_texts(spark, tmp_path, hard):
    docs = written(spark, tmp_path, hard, "doc_id long, text string")
    gone = covered(hard, 35)
    wanted = sorted((str(i), len(words(t)), len(g), hashlib.sha256(" ".join(x for j, x in enumerate(words(t)) if j not in g).encode()).hexdigest()) for (i, t), g in zip(hard, gone, strict=True))
    assert sorted((str(g["doc_id"]), g["n_words"], g["n_removed"], g["kept_sha256"]) for g in op4_substrings.remove(docs).collect()) == wanted
    wanted = sorted((str(i), sorted(g)) for (i, _), g in zip(hard, covered(hard, 50), strict=True))
    assert sorted((str(g["doc_id"]), sorted(x for s in g["spans"] for x in range(s["start"], s["end"]))) for g in op3_suffixes.spans(docs).collect()) == wanted


def similar_lines(rows):
    gone, seen = collections.defaultdict(list), []
    for n, (i, t) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(words(line))
            if s:
                if any(5 * len(s & o) >= 4 * len(s | o) for o in seen if 5 * len(s) >= 4 * len(o) and 5 * len(o) >= 4 * len(s)):
                    gone[n].append(k)
                seen.append(s)
    return sorted((str(i), gone[n]) for n, (i, _) in enumerate(rows))


def test_lines_of_hard_texts(spark, tmp_path, hard):
    rows = [r for r in hard if (r[1] or "").count("\n") < 100]
    docs = written(spark, tmp_path, rows, "doc_id long, text string")
    assert sorted((str(g["doc_id"]), list(g["removed"])) for g in op5_lines.report(docs).collect()) == similar_lines(rows)


def test_quality_of_hard_texts(spark, tmp_path, hard):
    rows = [(i, t, "h") for i, t in hard]
    got = {g["doc_id"]: g for g in op9_quality.assess(written(spark, tmp_path, rows, "doc_id long, text string, source string"), line_limit=1, line_share=0.0).collect()}
    lines = collections.Counter(line for _, t, _ in rows for line in {" ".join(words(x)).replace("0", "0") for x in re.sub("[0-9]", "0", t or "").lower().split("\n")} if line)
    for i, t, _ in rows:
        left = sum(len(words(x)) for x in (t or "").split("\n") if lines[" ".join(words(re.sub("[0-9]", "0", x).lower()))] <= 1)
        assert got[i]["n_left_words"] == left and got[i]["n_dup_lines"] == sum(n - 1 for n in collections.Counter(x for x in (t or "").split("\n") if words(x)).values())


@pytest.mark.parametrize("block", [None, 3, 40])
def test_lines_with_hot_words(spark, tmp_path, block):
    """One group of near copies shares its rarest words; its posting is dealt to blocks."""
    r = random.Random(5)
    core, rows = [f"c{i}" for i in range(12)], []
    for i in range(90):
        line = [*core, f"x{i}"] if i % 3 else [*r.sample(core, 9), f"y{i % 7}"]
        r.shuffle(line)
        rows.append((i, " ".join(line) + "\n" + " ".join(r.choice(core) for _ in range(r.randint(1, 30)))))
    docs = written(spark, tmp_path, rows, "doc_id long, text string")
    assert sorted((str(g["doc_id"]), list(g["removed"])) for g in op5_lines.report(docs, block=block).collect()) == similar_lines(rows)


@pytest.mark.parametrize("block", [2, 25])
def test_near_copies_with_hot_shingles(spark, tmp_path, block):
    r = random.Random(6)
    fresh = lambda k: [f"w{r.randrange(10**5)}" for _ in range(k)]
    core, rows = fresh(80), []
    for i in range(70):
        text = list(core)
        for at in r.sample(range(80), i % 4):
            text[at] = fresh(1)[0]
        rows.append((i, " ".join(text if i % 5 else core[:40] + fresh(40))))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words(t) for _, t in rows)]
    part = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    part[i] = part[j] = min(part[i], part[j])
    docs = written(spark, tmp_path, rows, "doc_id long, text string")
    assert sorted(g["doc_id"] for g in near_copies.dedup(docs, block=block).collect()) == sorted(set(part))


def test_postings_stay_whole_over_batches():
    token = [1, 1, 2, 2, 2, 2, 2, 2, 3, 4, 4, 4, 4, 4]
    for size in range(1, 8):
        batches = [pa.RecordBatch.from_arrays([pa.array(token[i : i + size]), pa.array(range(i, min(len(token), i + size)))], ["t", "i"]) for i in range(0, len(token), size)]
        out = [b.column(0).to_pylist() for b in set_join.groups(iter(batches))]
        assert [x for b in out for x in b] == token
        assert all(a[-1] != b[0] for a, b in zip(out[:-1], out[1:], strict=True))


def test_moved_splits_change_nothing(spark, tmp_path, hard):
    docs = written(spark, tmp_path, hard, "doc_id long, text string", 2)
    held = stored(docs, "text", "doc_id")
    before = {r["_slab"]: bytes(r["_blob"]) for r in held.blobs.collect()}
    removed = lambda: sorted((str(g["doc_id"]), g["kept_sha256"]) for g in op4_substrings.remove(docs).collect())
    first = removed()
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert {r["_slab"]: bytes(r["_blob"]) for r in held.blobs.collect()} == before
        assert removed() == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("parts", [4, 60])
def test_suffixes_of_a_hot_head(spark, tmp_path, parts):
    """A passage in most texts: its suffixes are spread over many partitions."""
    r = random.Random(8)
    fresh = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    passage = fresh(70)
    rows = [(i, " ".join(fresh(r.randint(0, 40)) + passage[r.randint(0, 25) : r.randint(45, 70)] + fresh(r.randint(0, 60)))) for i in range(150)]
    docs = written(spark, tmp_path, rows, "doc_id long, text string")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {g["doc_id"]: {x for s in g["spans"] for x in range(s["start"], s["end"])} for g in op3_suffixes.spans(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: g for (i, _), g in zip(rows, covered(rows, 50), strict=True)}


# --- language ID against brute force


def codes_of(text):
    b = [x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in (text or "").encode()]
    out = []
    for x, y, z in zip(b, b[1:], b[2:]):
        if y != 32 or (x != 32 and z != 32):
            c = (x * 0x9E3779B1 ^ y * 0x85EBCA6B ^ z * 0xC2B2AE35) & 0xFFFFFFFF
            c = ((c ^ c >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
            out.append(c >> 16)
    return out


def brute_language(train, asked):
    """train: (text, label); asked: (key, text, declared, suffix, host)."""
    seen = collections.defaultdict(collections.Counter)
    for t, label in set(x for x in train if x[0] is not None and x[1] is not None):
        seen[label].update(codes_of(t))
    names = sorted(x for x in seen if seen[x])
    size = 1 << 16
    logs = {x: (lambda c, total: lambda k: float(np.float32(math.log((c[k] + 0.05) / total))))(seen[x], sum(seen[x].values()) + 0.05 * size) for x in names}
    logs["und"] = lambda k: float(np.float32(-math.log(size)))
    names.append("und")
    scores = [[math.fsum(logs[x](k) for k in codes_of(t)) for x in names] for _, t, *_ in asked]
    first = [max(range(len(names)), key=lambda i: (s[i], -i)) if codes_of(a[1]) else None for s, a in zip(scores, asked, strict=True)]
    count = collections.defaultdict(collections.Counter)
    for f, (_, _, d, s, h) in zip(first, asked, strict=True):
        if f is not None:
            for group in ("all", ("s", s), ("h", s, h), ("d", d)):
                count[group][f] += 1
    total = sum(count["all"].values())
    base = [(count["all"][i] + 1e-3) / (total + 1e-3 * len(names)) for i in range(len(names))]

    def shrunk(group, above, weight):
        c = count.get(group)
        return above if c is None else [(c[i] + weight * p) / (sum(c.values()) + weight) for i, p in enumerate(above)]

    out = {}
    for (key, t, d, s, h), score in zip(asked, scores, strict=True):
        prior = shrunk(("h", s, h), shrunk(("s", s), base, 50.0), 20.0) if ("h", s, h) in count else base
        stated = count.get(("d", d))
        joint = [0.3 * x + math.log(p) for x, p in zip(score, prior, strict=True)]
        if stated:
            joint = [j + math.log((stated[i] + 5 * p) / (sum(stated.values()) + 5) / p) for i, (j, p) in enumerate(zip(joint, base, strict=True))]
        top = max(joint)
        at, sure = joint.index(top), 1 / math.fsum(math.exp(x - top) for x in joint)
        out[key] = (names[at], sure, bool(codes_of(t)) and names[at] != "und" and sure >= 0.6)
    return out


def check_languages(got, wanted):
    assert len(got) == len(wanted)
    for g in got:
        name, sure, kept = wanted[g[0]]
        assert g["language"] == name and abs(g["confidence"] - sure) < 1e-6 and g["kept"] == kept, g


def test_language_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    wanted = brute_language([(r["text"], r["lang"]) for r in rows], [(r["doc_id"], r["text"], r["lang"], None, r["source"]) for r in rows])
    check_languages(op1_language.query(spark, sf_dir).collect(), wanted)


def test_pages_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    asked = []
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        plain = re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&[a-z#0-9]+;", " ", p["html"])
        stated = re.search(r'(?i)<html[^>]*\blang="([a-z]+)', p["html"])
        host = re.match(r"[a-z]+://([^/:?#]+)", p["url"])[1].lower()
        asked.append((p["page_id"], plain, stated and stated[1].lower(), host.rsplit(".", 1)[-1], host))
    check_languages(op1_language.pages(spark, sf_dir).collect(), brute_language([(r["text"], r["lang"]) for r in rows], asked))


def test_language_fits_every_label(spark, tmp_path):
    """More labels than any table held before, rare ones, one row repeated, keys that say nothing."""
    r = random.Random(3)
    tongues = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)] for _ in range(90)]
    text = lambda i, n: " ".join(r.choice(tongues[i]) for _ in range(n))
    rows = [(None, text(i, 40), f"l{i:02d}") for i in range(90) for _ in range(3)] + [(7, "one row again and again", "l00")] * 3000 + [(None, None, "l01"), (None, "", None)]
    docs = written(spark, tmp_path, rows, "doc_id long, text string, lang string")
    assert op1_language.sample(docs, "text", "lang", 50).where("_text like 'one row%'").count() <= 1
    names, logs = op1_language.fit(docs, "text", "lang", 50)
    assert names == [f"l{i:02d}" for i in range(90)] and logs.shape == (90, op1_language.CODES)
    asked = spark.createDataFrame([(i, text(i, 30)) for i in range(90)], "doc_id long, text string")
    got = {g["doc_id"]: g["language"] for g in op1_language.identify(asked, (names, logs)).collect()}
    assert sum(got[i] == f"l{i:02d}" for i in range(90)) >= 88


# --- personal data


def test_secrets_and_repeated_keys(spark, tmp_path):
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows, planted, clean = [], {}, set()
    for i in range(1500):
        if i % 3 == 0:
            lead, secret = prose(30) + ' token = "', key()
            rows.append((i, lead + secret + '" ' + prose(20)))
            planted[i] = f"secret:{len(lead)}:{len(lead) + 40}"
        elif i % 3 == 1:
            rows.append((i, prose(30) + " commit " + key() + " " + prose(20)))
            clean.add(i)
        else:
            rows.append((None, prose(20) + f" mail a.{i}@mail{i % 9}.example.com " + prose(20)))
    rows += [(5000, "the same 1 text")] * 3000
    docs = written(spark, tmp_path, rows, "doc_id long, text string")
    model = op7_pii.fit(docs)
    got = {g["doc_id"]: g for g in op7_pii.find(docs, model).collect() if g["doc_id"] is not None}
    assert sum(planted[i] in got[i]["spans"].split(",") for i in planted) >= 0.9 * len(planted)
    assert sum(got[i]["n_added"] > 0 for i in clean) <= 0.05 * len(clean)
    assert all(g["n_spans"] == g["n_email"] + g["n_ip"] + g["n_card"] + g["n_phone"] + g["n_added"] for g in got.values())


# --- SentencePiece


def as_unigram():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(op10_sentencepiece.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_query_encodes_like_the_library(spark, sf_dir):
    import sentencepiece

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    library = sentencepiece.SentencePieceProcessor(model_file=op10_sentencepiece.MODEL)
    got = op10_sentencepiece.query(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g["ids"] == library.encode(texts[g["doc_id"]])
        assert g["n_tokens"] == len(g["ids"]) and g["n_viterbi"] == len(g["viterbi_ids"]) and g["round_trip"] and g["viterbi_round_trip"]
        assert library.decode(g["viterbi_ids"]) == library.decode(g["ids"])


def test_viterbi_finds_the_library_s_best(sf_dir):
    """The library's own lattice is exact; its encode() adds up single floats and is not, on these scores."""
    library, v = as_unigram(), op10_sentencepiece.load(unigram=True)
    texts = duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    every = sorted({w for (t,) in texts[:80] for w in t.split()})
    data, offsets = K.text_buffers(pa.array(every))
    ids, bounds = op10_sentencepiece.encode(v, data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [library.nbest_encode_as_ids(w, 2)[0] for w in every]


@pytest.mark.parametrize("memo", [0, 5, 200_000])
def test_memo_and_hard_segments(monkeypatch, memo):
    monkeypatch.setattr(op10_sentencepiece, "MEMO", memo)
    texts = [thue_morse(2048), thue_morse(2048, True), None, "", "  the  cat\n\n sat ", "日本語😀 x\t\ty", "a" * 300 + " " + "ab" * 100, "the cat", thue_morse(40), thue_morse(40, True), "the cat the"]
    for v in (op10_sentencepiece.load(), op10_sentencepiece.load(unigram=True)):
        one = {}
        for t in texts:
            ids, _ = op10_sentencepiece.encode(v, *K.text_buffers(pa.array([t], pa.string())))
            one[t] = ids.tolist()
        kept = op10_sentencepiece.Memo()
        for turn in (texts, texts[::-1], texts[:4]):
            ids, bounds = op10_sentencepiece.encode(v, *K.text_buffers(pa.array(turn, pa.string())), kept)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [one[t] for t in turn]
            back, at = op10_sentencepiece.decode(v, ids, bounds)
            assert [back[at[i] : at[i + 1]].tobytes().decode() for i in range(len(turn))] == [t or "" for t in turn]


def test_segments_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(K, "span_hash", lambda values, starts, ends, base=None: np.zeros(len(starts), np.uint64))
    text = np.array([ord(c) for c in "abcabdabc"], np.int64)
    _, one, which = op10_sentencepiece.distinct(text, np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert which[0] == which[2] != which[1] and len(one) == 2


def test_null_ids_decode_to_nothing(spark):
    v = op10_sentencepiece.load()
    got = op10_sentencepiece.texts(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), v).collect()
    assert [g["text"] for g in got] == ["", ""]


# --- SQL


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_against_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = registry.QUERIES[name](spark, sf_dir)
    frame = db.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in frame.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, frame.fetchall()))


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from quarry.llm import common

    session = lambda known: SimpleNamespace(conf={"spark.checkpoint.dir": known}, sparkContext=SimpleNamespace(master="spark://somewhere:7077", applicationId="app"))
    assert common.shared_dir(session("hdfs://shared/")) == "hdfs://shared"
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(session(None))
