import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from classyard.llm import rans
from classyard.llm.tokens import ChunkEncoder

from .util import edge_docs, empty_docs

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")

ODD = ["", None, "  a  b", "x\n\ny", "a\n b", "it's  I'll don't", "\ta b", "a <|endoftext|> b", "ÀÉ é ́x",
       "\n", "Σας Σ", "a\x1cb c", "x \x00 y", "a\r\nb", "tab\tx y ", "a\x02b \x02 c", "a. \x02", "a.\n", "a., b",
       "x.\n ,y z.,", "é, b. c", "I. i' s. 's, b", "b.  c", "1, 2. 3", "　a b c", "x" * 3000]


@pytest.mark.parametrize("path,blank", [(WORD, False), (BYTE, True)])
def test_chunked_encoding_equals_whole_text_encoding(path, blank):
    rng = random.Random(3)
    alphabet = "ab AB\n\t.,'!1é Σ#"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    enc = ChunkEncoder(path, blank, memo=2000)
    want = [e.ids + [1] for e in enc.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = [x.tolist() for lo in range(0, len(texts), 500) for x in enc.encode(texts[lo:lo + 500], 1)]
    assert got == want


@pytest.mark.parametrize("path,blank", [(WORD, False), (BYTE, True)])
def test_special_tokens_as_the_library_encodes_them(path, blank):
    from tokenizers import Tokenizer
    texts = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>", "a <|ENDOFTEXT|> b", "a <|endoftext| > b", "plain text", None,
             "<|endoftext|><|endoftext|>\n\n c."]
    fresh = Tokenizer.from_file(path)
    want = [fresh.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert [x.tolist() for x in ChunkEncoder(path, blank).encode(texts, 1)] == want


def test_block_round_trip_segments_and_damage():
    rng = np.random.default_rng(0)
    counts = np.bincount((rng.zipf(1.3, 700_000) % 50_000).astype(np.int64), minlength=1 << 16)
    table = rans.Table(counts)
    assert int(table.freq.sum()) == 1 << rans.SCALE and (table.freq[counts > 0] > 0).all()
    ids = np.repeat(np.arange(1 << 16, dtype=np.uint16), counts)
    rng.shuffle(ids)
    parts = np.split(ids, [1, 1, 300, 300_000])
    payload = rans.pack_block([None, 2, 2, 5, 9], parts, table)
    docs, back = rans.unpack_block(payload, table, table.slots())
    assert docs == [None, 2, 2, 5, 9] and all((a == b).all() for a, b in zip(parts, back))
    assert len(payload) < 2 * len(ids)
    marks, words = rans.encode_ids(ids, table)   # the last segment alone, from its checkpoint
    k = len(marks) - 1
    seg = rans.decode_segment(k, len(ids), marks[k], words.astype(np.uint64), table, table.slots())
    assert (seg == ids[k * rans.STEPS * rans.LANES:]).all()
    bad = bytearray(payload)
    bad[-3] ^= 1
    with pytest.raises(ValueError):
        rans.unpack_block(bytes(bad), table, table.slots())
    with pytest.raises(ValueError):
        rans.unpack_block(payload, rans.Table(counts + 1), table.slots())


def test_one_symbol_and_no_symbol():
    counts = np.zeros(10, np.int64)
    assert rans.quantise(counts).sum() == 0
    counts[4] = 9
    t = rans.Table(counts)
    _, back = rans.unpack_block(rans.pack_block([1], [np.full(9, 4, np.uint16)], t), t, t.slots())
    assert back[0].tolist() == [4] * 9


def test_digests_against_brute_force(spark):
    df = edge_docs(spark)
    got = rans.token_digests(df, WORD).collect()
    tok = ChunkEncoder(WORD, False).tok
    rows = [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in df.collect()]
    want = sorted(((-1 if d is None else d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.doc_id is not None for r in got][0] is False
    ids = [r.doc_id for r in got][1:]
    assert ids == sorted(ids)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert rans.token_digests(empty_docs(spark), WORD).count() == 0
