import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_llm_shared import frame
from tokenizers import Tokenizer

from echotrace.llm import pfor_tokens as P
from echotrace.llm.token_ids import WordEncoder, tokenizer_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.sampled_from([0, 50, 95, 100]))
def test_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    cuts = np.array([len(ids) // 3, len(ids) - len(ids) // 3])
    part = P.pack(ids, cuts, percentile)
    back, per_doc = P.unpack(part)
    assert (back == ids).all() and len(back) == len(ids) and (per_doc == cuts).all()
    if len(ids) > 2 * P.BLOCK:
        one, _ = P.unpack(part, slice(1, 2))
        assert (one == ids[P.BLOCK:2 * P.BLOCK]).all()


def test_not_a_part():
    with pytest.raises(ValueError):
        P.unpack(b"XXXX" + bytes(40))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60)
                | st.text(st.sampled_from("aZé'.,!s <|>\t\n\x0b\x1c\u00a0\u0301İΣ٣9"), max_size=40), min_size=1, max_size=8))
def test_word_wise_ids_are_the_library_ids(texts):
    texts = texts + ["<|endoftext|> <|ENDOFTEXT|> don't I'LL x's."]
    lib = Tokenizer.from_file(tokenizer_path())
    ids, per_text = WordEncoder.at(tokenizer_path()).encode(pa.array(texts), 2)
    want = [e.ids + [2] for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert per_text.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_files_in_id_order(spark, tmp_path, edge_rows):
    P.write_files(frame(spark, edge_rows).repartition(5), str(tmp_path / "t"), tokenizer_path(), 2)
    got = sorted(P.read_documents(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    lib = Tokenizer.from_file(tokenizer_path())
    assert len(got) == len(edge_rows)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _, _ in edge_rows if i is not None)
    assert [r.doc_id for r in got][:2] == [None, None]
    at, texts = 0, {}
    for i, t, _ in edge_rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        texts.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        at += r.n_tokens
    P.write_files(frame(spark, []), str(tmp_path / "e"), tokenizer_path(), 2)
    assert P.read_documents(spark, str(tmp_path / "e")).count() == 0
