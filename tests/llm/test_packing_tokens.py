import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopframe.llm import common, encoding, packing, token_files

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
TEXTS = ["Hello, world!", None, "", "a  b\n\nc's <|endoftext|> é ő", "x" * 50, "long words here " * 900, "Hello, world!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en"), (None, "no id", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, offset string")  # a clashing extra column


@pytest.mark.parametrize(("name", "end"), [(BYTE, 0), (WORD, 2)])
def test_remembered_pieces_are_the_librarys_ids(name, end):
    rng = random.Random(5)
    letters = [*"ab CD'e  .,;!?<|>()-_12\n\t éàßñ÷×ő€", "'s", "'re ", "<|endoftext|>", " the", "\n\n", " \n", "''"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + TEXTS
    path = encoding.public_path(name)
    ids, bounds = encoding.encode(pa.array(texts), path, end)
    want = encoding.tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(list(ids[bounds[i] : bounds[i + 1]]) == [*w.ids, end] for i, w in enumerate(want))


class Counted:
    """A tokenizer that notes what it is given."""

    def __init__(self, name):
        self.real, self.texts = encoding.tokenizer(encoding.public_path(name)), []
        self.model, self.get_vocab = self.real.model, self.real.get_vocab

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.real.encode_batch_fast(texts, **options)


def encoded(pieces, texts):
    ids, count = pieces.encode(*common.text_buffers(pa.array(texts)))
    want = [x.ids for x in pieces.model.real.encode_batch(texts, add_special_tokens=False)]
    ends = np.cumsum(count)
    return [ids[e - n : e].tolist() for e, n in zip(ends, count)] == want


def made_up(rng, n):
    return ["".join(rng.choice("abcdeghiklmnorstuvwzABEéßñ") for _ in range(rng.randint(1, 12))) for _ in range(n)]


@pytest.mark.parametrize("name", [BYTE, WORD])
@pytest.mark.parametrize("marks", [True, False])
def test_new_words_go_to_the_library_together(name, marks):
    rng, model = random.Random(7), Counted(name)
    pieces = encoding.Pieces(model)
    if not marks:  # a vocabulary that doesn't tell words apart: one by one, with the same ids
        pieces.marks[:] = False
    texts = ["", *(" ".join(made_up(rng, k)) for k in (1, 2, 63, 64, 65, 128, 129, 3000)), "", "it's  2nd,word\nÉtat 7x\n"]
    assert encoded(pieces, texts)
    assert len(model.texts) < 200 if marks else len(model.texts) > 3000


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_words_met_again_stay_when_memory_is_full(name, monkeypatch):
    monkeypatch.setattr(encoding, "MOST_PIECES", 400)
    rng, model = random.Random(8), Counted(name)
    pieces, common_words = encoding.Pieces(model), ["Zebra", *made_up(rng, 100)]
    for _ in range(20):
        assert encoded(pieces, ["; ".join([*common_words, *made_up(rng, 60)]), "a " + " ".join(common_words)])
        assert len(pieces.keys) <= 400
    given = " ".join(model.texts).split()
    assert given.count(common_words[3]) <= 2  # with and without the mark after it
    assert encoded(pieces, [" ".join(made_up(rng, 3000))]) and encoded(pieces, [" ".join(common_words)])  # more than memory holds, at once


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    raw = token_files.pack(ids, bits)
    assert len(raw) == -(-1000 // 64) * 8 * bits
    assert (token_files.unpack(raw, bits, 1000) == ids).all()
    assert token_files.bits_for(49_408) == 16 and token_files.bits_for(2) == 1 and token_files.bits_for(65_537) == 17


def test_random_access(tmp_path):
    w = token_files.ShardWriter(f"file://{tmp_path}", 16, 128)
    docs = [np.arange(n, dtype=np.uint32) for n in (0, 5, 300, 1, 20_000, 7)]
    for i, d in enumerate(docs):
        w.add(None if i == 3 else i, d)
    path, n_ids, n_docs = w.close()
    r = token_files.ShardReader(path)
    assert (n_ids, n_docs) == (sum(map(len, docs)), 6)
    for i in (4, 0, 5, 2, 1, 3):
        assert (r.document(i) == docs[i]).all()
    assert [d[0] for d in r.documents(100)] == [0, 1, 2, None, 4, 5]
    assert (r.ids(250, 260) == np.concatenate(docs)[250:260]).all()


def test_files_against_plain_encoding(spark, docs):
    path = encoding.public_path(WORD)
    manifest = token_files.write_tokens(docs, path, 2, common.new_dir(spark, "t"), shard_ids=2000)
    rows = token_files.read_documents(manifest).orderBy("start").collect()
    ordered = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in ordered]
    at = 0
    for r, (_, t) in zip(rows, ordered):
        ids = [*encoding.tokenizer(path).encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_packs_everything_without_gaps(spark, docs):
    path = encoding.public_path(BYTE)
    rows = packing.pack(docs, path, 0, 128).collect()
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.start), []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 128
    total = sum(r.length for r in rows)
    assert total == sum(len(encoding.tokenizer(path).encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    long = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.piece)
    assert all(r.length == 128 for r in long[1:]) and [r.piece for r in long] == list(range(len(long)))
    whole = packing.sequences(packing.pack(docs, path, 0, 128)).agg(F.sum(F.octet_length("ids"))).first()[0]
    assert whole == 4 * total


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 64, 500])
    counts = {rng.randint(1, cap): rng.randint(1, 2000) for _ in range(rng.randint(1, 60))}
    p = packing.Plan(dict(counts), cap)
    used = {}
    for lengths, times in p.runs:
        assert sum(lengths) <= cap and times > 0
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts
    n = sum(t for _, t in p.runs)
    assert n >= -(-sum(k * v for k, v in counts.items()) // cap)


def test_exact_complements_fill_sequences():
    p = packing.Plan({6: 2, 4: 2, 5: 4, 7: 3, 2: 3, 1: 3}, 10)
    assert sum(t for _, t in p.runs) == 7 and all(sum(x) == 10 for x, _ in p.runs)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, encoding.public_path(BYTE), 0, 64).count() == 0
    manifest = token_files.write_tokens(none, encoding.public_path(WORD), 2, common.new_dir(spark, "t"))
    assert token_files.read_documents(manifest).count() == 0
