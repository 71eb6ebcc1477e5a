"""Posted tokens of lines are dealt to their pass once, in the kernel."""

import math

import numpy as np

from quarry.llm import op5_lines as O
from quarry.llm.slabs import stored


def test_each_posted_token_is_in_one_list(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"common w{i % 7} x{j} y{i * j} z{j % 3}" for j in range(9))) for i in range(40)], "doc_id bigint, text string")
    held = stored(docs, "text", "doc_id")
    rank, words = O.rarity(held)
    far = 0
    for r in O.lines(held, rank, -(-words // 10)).collect():
        posted = []
        for k in range(O.PASSES):
            assert all(t % O.PASSES == k for t in r[f"_tokens{k}"]) and len(r[f"_tokens{k}"]) == len(r[f"_pos{k}"])
            posted += r[f"_pos{k}"]
        assert all(b > 1 for b in r["_blocks"]) and len(r["_far"]) == len(r["_fpos"]) == len(r["_blocks"])
        far += len(r["_far"])
        assert sorted(posted + r["_fpos"]) == list(range(r["_n"] - math.ceil(0.8 * r["_n"] - O.EPS) + 1))
    assert far and isinstance(rank, np.ndarray)
