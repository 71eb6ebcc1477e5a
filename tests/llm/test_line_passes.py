"""Lines are named and words counted in one pass; only the first line of each set is posted, sealed by slab."""

import collections
import re

import numpy as np
import pyarrow as pa

from quarry.llm import kernels as K, op5_lines as O
from quarry.llm.slabs import stored

TEXTS = ["a b c\n\nb c a\nd", "", None, "\n\n", "x y\n", "d\nq" + " w" * 300, "é ß é\n \t\nx y"]


def held_of(spark):
    return stored(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").coalesce(2), "text", "doc_id")


def test_one_pass_names_lines_and_counts_words(spark):
    held = held_of(spark)
    rows = O.named(held).where("_piece is null").collect()
    sets = collections.defaultdict(set)
    for r in rows:
        sets[r["_s1"], r["_s2"]].add(r["_key"])
    texts = [line for t in TEXTS for line in (t or "").split("\n") if line.split()]
    assert len(rows) == len(texts) and len(sets) == len({frozenset(x.split()) for x in texts})
    assert sorted(map(sorted, sets.values())) == [[0], [0, 5], [4, 6], [5], [6]]
    rank, words = O.rarity(held, O.named(held))
    assert sorted(rank.tolist()) == list(range(1 << O.SLOT_BITS)) and words.sum() == sum(len(t.split()) for t in TEXTS if t)
    assert words[O._slot(K.words_of(*K.text_buffers(pa.array(["w"]))).hashes())].tolist() == [300]


def test_picked_lines_are_rows_without_their_breaks():
    texts = K.text_buffers(pa.array(TEXTS))
    begin, _ = O._bounds(*texts)
    every = re.split("\n", "\n".join(t or "" for t in TEXTS))
    assert len(begin) == len(every)
    some = O.picked(*texts, np.arange(len(begin)))
    raw = some.data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(some.offsets[:-1], some.offsets[1:], strict=True)] == every
    assert not len(O.picked(*texts, np.empty(0, np.int64)).data)


def test_sealed_lines_hold_what_is_posted_of_them(spark):
    held = held_of(spark)
    rank, words = O.rarity(held)
    blocks = words  # every word that comes twice is dealt
    wanted = O.named(held).where("_piece is null").selectExpr("_slab", "_line", "_slab * 1000 + _line as a")
    sealed = O.lines(held, rank, blocks, wanted=wanted)
    assert sealed.columns == ["_rows"]
    got, far = collections.Counter(), O.long(sealed, ["_far", "_fpos", "_blocks"], ["token", "pos", "blocks"]).collect()
    for k in range(O.PASSES):
        got.update((r["token"], r["pos"], r["n"], r["sig0"], r["sig1"]) for r in O.long(sealed, [f"_tokens{k}", f"_pos{k}"], ["token", "pos"]).collect())
    got.update((r["token"], r["pos"], r["n"], r["sig0"], r["sig1"]) for r in far)
    plain = collections.Counter()
    for r in O.lines(held, rank, blocks).collect():
        for tokens, places in [*((r[f"_tokens{k}"], r[f"_pos{k}"]) for k in range(O.PASSES)), (r["_far"], r["_fpos"])]:
            plain.update((t, p, r["_n"], r["_sig0"], r["_sig1"]) for t, p in zip(tokens, places, strict=True))
    assert got == plain and far and {r["a"] for r in far} <= {r["a"] for r in wanted.collect()}
