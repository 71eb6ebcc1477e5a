"""Each stage of the pipeline against brute force, on what the stage before it kept."""

import collections
import re

import pytest
import sentencepiece
from test_limits import brute_language

import corpus_pipeline
from quarry.llm import op10_sentencepiece

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def words(t):
    return WORD.findall(t or "")


def language(rows):
    verdict = brute_language([(r["text"], r["lang"]) for r in rows], [(i, r["text"], r["lang"], None, r["source"]) for i, r in enumerate(rows)])
    return [r for i, r in enumerate(rows) if verdict[i][2]]


def lines(rows):
    out, seen = [], []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"])):
        kept = []
        for line in (r["text"] or "").split("\n"):
            s = frozenset(words(line))
            if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in seen if 5 * len(s) >= 4 * len(o) and 5 * len(o) >= 4 * len(s)):
                kept.append(line)
            if s:
                seen.append(s)
        text = None if r["text"] is None else "\n".join(kept)
        if words(text) or not words(r["text"]):
            out.append({**r, "text": text, "n_chars": None if text is None else len(text)})
    return out


def near(rows):
    def shingles(t):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, part = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    by = collections.defaultdict(set)
    for i, s in enumerate(sets):
        for x in s or {()}:
            by[x].add(i)

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, j in {(i, j) for group in by.values() for i in group for j in group if j < i}:
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            part[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        first[find(i)] = min(first.get(find(i), r["doc_id"]), r["doc_id"])
    return [r for r in rows if r["doc_id"] in set(first.values())]


def plain(rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=str)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    path, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out.append([r.asDict() for r in docs.collect()])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(path / str(i)))
        docs = spark.read.parquet(str(path / str(i)))
        out.append([r.asDict() for r in docs.collect()])
    return out


@pytest.mark.parametrize("i, brute", enumerate((language, lines, near)))
def test_filtering_stages(stages, i, brute):
    assert plain(stages[i + 1]) == plain(brute(stages[i]))


def test_mixing_stage(stages):
    before, after = stages[3], stages[4]
    size, taken = collections.Counter(), collections.Counter()
    largest = collections.Counter()
    for r in before:
        n = len(words(r["text"]))
        size[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    copies = collections.Counter(plain(after))
    assert set(copies) == {x for x in plain(before) if words(x[1])} and set(copies.values()) <= {1, 2}
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
    scale = max(n**0.3 for n in size.values() if n)
    for source, n in size.items():
        target = min(2 * n, max(n, scale * n**0.7))
        assert abs(taken[source] - target) <= largest[source]


def test_token_stage(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=op10_sentencepiece.MODEL)
    wanted = sorted(str((r["doc_id"], r["source"], r["lang"], library.encode(r["text"] or ""))) for r in stages[4])
    assert sorted(str((r["doc_id"], r["source"], r["lang"], list(r["ids"]))) for r in stages[5]) == wanted
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in stages[5])


def test_run_is_the_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(str(r.asDict()) for r in got) == sorted(map(str, stages[5]))
