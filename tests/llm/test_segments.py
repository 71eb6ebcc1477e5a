"""Segments of the SentencePiece operator: cuts, keys, memo, sums."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import kernels as K, op10_sentencepiece as S


def rows_of(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_cut_where_no_piece_has_two_characters_side_by_side():
    v = S.vocabulary(["<unk>", "▁", "a", "b", "c", "ab", "▁a"], [0.0, -1, -2, -3, -4, -5, -6], [2] + [1] * 6, False)
    text, _, _, starts, *_ = S.split(v, *K.text_buffers(pa.array(["abba cab", "", "ab"])))
    assert "".join(map(chr, text)) == "▁abba▁cab▁ab"
    assert starts.tolist() == [0, 3, 4, 5, 6, 7, 9]  # ▁ab b a ▁ c ab ▁ab, but "ca" and "▁c" are cut
    assert (np.diff(np.append(starts, len(text))) > 0).all()


@pytest.mark.parametrize("count", [0, 1, 5000])
def test_keys_are_found_and_others_are_not(count):
    r = random.Random(count)
    known = {r.randrange(1 << 62): i for i in range(count)}
    keys = S._keys(np.array(list(known), np.int64), np.arange(count))
    asked = np.array([*known, *(r.randrange(1 << 62) for _ in range(9000)), 0], np.int64)
    assert S._probe(keys, asked).tolist() == [known.get(k, -1) for k in asked.tolist()]


def test_scores_far_apart_do_not_round_others_away():
    v = S.load(unigram=True)
    ids, _ = S.encode(v, *K.text_buffers(pa.array(["ßverach"])))
    assert [v.pieces[i] for i in ids] == ["▁", "ß", "ve", "ra", "ch"]  # 6 better than ver, ach, behind a piece of -1e9
    ids, _ = S.viterbi(v, np.array([[ord(c) for c in "▁ßverach"]], np.int64))
    assert [v.pieces[i] for i in ids[0][:5]] == ["▁", "ß", "ve", "ra", "ch"]


def test_memo_keeps_what_is_asked_for_again(monkeypatch):
    monkeypatch.setattr(S, "MEMO", 40)
    plain, r = S._encoded, random.Random(3)
    for v in (S.load(), S.load(unigram=True)):
        turns = [["the cat sat", *("".join(r.choices("aeinst", k=8)) for _ in range(9))] for _ in range(30)]
        alone = [[rows_of(*S.encode(v, *K.text_buffers(pa.array([t]))))[0] for t in texts] for texts in turns]
        encoded, memo = [], S.Memo()

        def noted(v, text, s, size, encoded=encoded):
            encoded += ["".join(map(chr, text[a : a + n])) for a, n in zip(s, size, strict=True)]
            return plain(v, text, s, size)

        monkeypatch.setattr(S, "_encoded", noted)
        assert [rows_of(*S.encode(v, *K.text_buffers(pa.array(texts)), memo)) for texts in turns] == alone
        monkeypatch.setattr(S, "_encoded", plain)
        assert [encoded.count(w) for w in ("▁the", "▁cat", "▁sat")] == [1, 1, 1] and memo.older is not None
        assert len(memo.keys) <= 40 and (np.diff(memo.keys.astype(object)) > 0).all()


def test_segments_of_one_byte_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(K, "byte_hash", lambda data, starts, ends, base=None: np.zeros(len(starts), np.uint64))
    text = np.array([ord(c) for c in "abcabdabc"], np.int32)
    _, one, which = S.distinct(text, np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert which[0] == which[2] != which[1] and len(one) == 2
