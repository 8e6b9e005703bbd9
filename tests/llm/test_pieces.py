import random

import public_tokenizers
import pytest
import sentencepiece

from foliant.llm import counts, packing, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a", " a", "▁a", "a\nb\n\n", "<s>hi</s>", "<0x0A>", "\u0000x", "é😀中", "a  b   ", "a" * 3000, "ab" * 2000, "=" * 999, "x " * 500, " " * 777, "\n" * 55]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _texts():
    r = random.Random(1)
    return TEXTS + ["".join(r.choice("aaab  \n\t=-ab▁é😀中ñ<s>0x\u0000") for _ in range(r.randrange(60))) for _ in range(1500)]


def test_encoding_decoding_and_counts_are_the_library_s(lib):
    model = pieces.load(MODEL)
    for t in _texts():
        ids = lib.encode(t)
        assert model.encode(t) == ids, t
        assert model.decode(ids) == lib.decode(ids), t


def test_counts_are_the_library_s(spark, lib):
    texts = list(enumerate(_texts()))
    got = counts.count_tokens(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {i: (len(t.encode()), len(lib.encode(t))) for i, t in texts}


def test_packed_rows_are_written_and_read(spark, lib, tmp_path):
    import numpy as np

    texts = {i: t for i, t in enumerate(_texts()[:300])}
    packed = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), capacity=64, shard_chars=2000)
    packing.write_packed(packed, f"{tmp_path}/packed")
    parts = {}
    for r in spark.read.parquet(f"{tmp_path}/packed").collect():
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 64 and not ids[r.n_tokens :].any() and not places[r.n_tokens :].any()
        for doc, no, lo, hi in zip(r.doc_ids, r.piece_nos, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts[doc, no] = ids[lo:hi].tolist()
            assert places[lo:hi].tolist() == list(range(hi - lo))
    for i, t in texts.items():
        assert [x for k in range(len(lib.encode(t)) // 64 + 1) for x in parts.get((i, k), [])] == lib.encode(t)


def test_decoding_bytes_that_are_no_text():
    model = pieces.load(MODEL)
    assert model.decode([int(model.byte_ids[0xC3])]) == "�"


def test_cache_forgets_without_changing_results(lib):
    cache = pieces.WordCache(pieces.load(MODEL), pieces.as_bytes("<i4"), most=50)
    texts = _texts()
    import numpy as np

    assert [np.frombuffer(b"".join(x), np.int32).tolist() for x in cache.texts(texts, 40)] == [lib.encode(t) for t in texts]


def test_odd_rows(spark, odd_docs, lib):
    got = sorted(map(tuple, pieces.encode(odd_docs).collect()), key=repr)
    want = sorted(((r.doc_id, lib.encode(r.text or ""), lib.decode(lib.encode(r.text or ""))) for r in odd_docs.collect()), key=repr)
    assert got == want
    n = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counts.count_tokens(odd_docs, limit=5).collect()), key=repr)
    assert n == sorted(((i, len((t or "").encode()), len(x), len(x) > 5) for (i, x, _), t in zip(want, [r.text for r in sorted(odd_docs.collect(), key=lambda r: repr((r.doc_id, lib.encode(r.text or ""), lib.decode(lib.encode(r.text or "")))))], strict=True)), key=repr)
    digests = pieces.encode_digests(odd_docs)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and digests.count() == 9
    assert pieces.encode(odd_docs.limit(0)).count() == counts.count_tokens(odd_docs.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_row():
    r = random.Random(3)
    for _ in range(50):
        lengths = sorted((r.randrange(1, 33) for _ in range(80)), reverse=True)
        rooms = []
        for k, n in enumerate(lengths):
            fitting = [room for room in rooms if room[0] >= n]
            if fitting:
                best = min(x[0] for x in fitting)
                row = [x for x in rooms if x[0] == best][-1]
            else:
                row = [32, []]
                rooms.append(row)
            row[0] -= n
            row[1].append(k)
        got = packing.best_fit(lengths, 32)
        assert sorted(sum(lengths[k] for k in row) for row in got) == sorted(32 - x[0] for x in rooms)
        assert sorted(k for row in got for k in row) == list(range(80))


def test_packing_loses_nothing(spark, odd_docs, lib):
    import numpy as np

    rows = packing.pack(odd_docs, capacity=64, pad_id=2, shard_chars=50_000).collect()
    parts = []
    for r in rows:
        ids, at = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(at) == 64 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 2).all()
        for d, no, a, b in zip(r.doc_ids, r.piece_nos, r.cu_seqlens, r.cu_seqlens[1:]):
            assert at[a:b].tolist() == list(range(b - a))
            parts.append((d, no, ids[a:b].tolist()))
    # every piece of every row of the input, as often as it occurs
    want = []
    for d in odd_docs.collect():
        ids = lib.encode(d.text or "")
        want += [(d.doc_id, k, ids[64 * k : 64 * k + 64]) for k in range(-(-len(ids) // 64))]
    assert sorted(parts, key=repr) == sorted(want, key=repr)
    assert packing.pack(odd_docs.limit(0)).count() == 0
