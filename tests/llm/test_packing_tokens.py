"""Token ids, packing and token files against the tokenizers library itself and exact round trips."""

import random
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from acctpulse.llm import packing, token_file, tokens
from acctpulse.llm.tokens import SPACE, Encoder, blocks, tokenizer_path

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
EDGE = [
    None, "", " ", "\n\n", "a", "don't we'll  stop", " lead", "trail  ", "a\t\t b\n\n\nc", "x" * 5000, "é" * 3,
    "<|endoftext|> a<|startoftext|>", "a\x1cb!\x1c!", "!\x85!  x", "é ́a", "ΣΑΣ ΟΔΟΣ", "💥 ​ z",
]


def plain(name, texts):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
def test_chunks_give_the_ids_of_the_whole_text(name):
    rng = random.Random(7)
    marks = [*SPACE, *" \n    ", "word", "naïve", "Ǆ", "and,", "x.", "\x1c", "\x85", "́", "a", "Be", "'s", "'", "1", "23", "!", "?!", "é", "ß", "Σ", "漢", "<|endoftext|>"]
    texts = [*EDGE, *("".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(1500))]
    own = Encoder(name, cache_chunks=50)
    for text, ids in zip(texts, plain(name, texts)):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids[:-1], repr(text)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("most", [100, 1 << 22])
def test_groups_give_the_ids_of_the_whole_texts(name, most, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_CHARS", most)
    rng = random.Random(8)
    marks = [*SPACE, *" \n    ", "Word", "WORD", "don't", "rock'n'", "'s'", "naïve", "Ǆ", "and,", "x.»", "»,", "J̌", "H̱", "T̈", "\u030c", "İ", "\x1c", "İ,", "́", ".", "1.", "23", "²!", "!?!", "Σ", "ΣΑΣ.", "漢,", "<|endoftext|>"]
    texts = [*EDGE, *("".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(1500)), "many Words, " * 3000, "", None]
    own = Encoder(name, cache_chunks=50)
    got = list(own.encode_many(iter(texts)))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids[:-1] for ids in plain(name, texts)]
    assert list(own.encode_many([])) == [] and list(own.encode_many(["", None])) == [b"", b""]


@pytest.mark.parametrize("name", NAMES)
def test_words_whose_lower_case_has_a_mark(name):
    texts = ["x İ", "x İSTANBUL, x", "İ İ.\nİx"]
    own = Encoder(name)
    want = [ids[:-1] for ids in plain(name, texts)]
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_many(texts)] == want


def test_a_word_of_many_texts_is_looked_up_once(monkeypatch):
    own, looked_up = Encoder(NAMES[1]), []
    monkeypatch.setattr(own, "_ids", lambda piece: looked_up.append(piece) or Encoder._ids(own, piece))
    texts = ["The fox, the naive fox\nand THE fox."] * 500
    assert list(own.encode_many(texts)) == [own.encode(texts[0])] * 500
    assert sorted(looked_up) == ["and", "fox", "fox,", "fox.", "naive", "the"]


def test_blocks_join_to_the_text_and_keep_ids():
    text = "word another\n\n x  " * 400
    parts = list(blocks(text, 50))
    assert "".join(parts) == text and len(parts) > 50 and max(map(len, parts)) < 80
    own = Encoder(NAMES[0])
    assert b"".join(map(own.encode, parts)) == own.encode(text)


@pytest.mark.parametrize("name", NAMES)
def test_cache_of_long_words_stays_small(name):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=3000)) for _ in range(5)) for _ in range(30)]
    texts += [t.replace(" ", "\t ") for t in texts[:15]]
    own = Encoder(name, cache_bytes=100_000)
    for text, ids in zip(texts, plain(name, texts)):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids[:-1]
        for cache in (own.pieces, own.old, own.chunks):
            assert sum(len(k) + len(v) for k, v in cache.items()) < 300_000


def test_packed_batches_hold_few_ids(monkeypatch):
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    ints, ids = pa.int64(), pa.list_(pa.int32())
    schema = pa.schema([(c, ids if c == "ids" else ints) for c in [*packing._FIELDS, "ids"]])
    # Two documents of many windows, then many short ones.
    texts = ["the quick fox " * 500_000] * 2 + ["a naïve fox " * 300] * 1500
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), ints), pa.array(texts)], names=["doc_id", "text"])
    got = list(packing._pack_partition(iter([given]), NAMES[0], 2048, True, schema))
    assert max(len(b.column("ids").flatten()) * 4 for b in got) <= (1 << 22) + 4 * 2048
    tokens = defaultdict(int)
    for b in got:
        for d, n in zip(b.column("doc_id").to_pylist(), b.column("length").to_pylist()):
            tokens[d] += n
    want = {t: len(Encoder(NAMES[0]).encode(t)) // 4 + 1 for t in set(texts)}
    assert tokens == {d: want[t] for d, t in enumerate(texts)}


def check_sequences(pieces, docs, name, size):
    """Pieces tile every document, sequences are gapless and need no padding."""
    ids_of = {d: ids for (d, _), ids in zip(docs, plain(name, [t for _, t in docs]))}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids_of)
    for d, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids_of[d]) and p.length > 0
            piece = ids_of[d][at : at + p.length]
            assert p.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
            if "ids" in p:
                assert p.ids == piece
            at += p.length
        assert at == len(ids_of[d])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size and (at == size or at & (at - 1) == 0)
    return by_sequence


def test_packing_is_exact_and_unpadded(spark):
    rng = random.Random(3)
    texts = [*EDGE, *(" ".join(rng.choice(["the", "quick", "fox", "naïve"]) for _ in range(rng.randrange(1, 400))) for _ in range(300))]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    by_sequence = check_sequences(packing.pack(df, size=256).collect(), docs, NAMES[0], 256)
    total = sum(p.length for own in by_sequence.values() for p in own)
    assert len(by_sequence) <= total / 256 + 3 * 9


def test_packing_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    check_sequences(packing.pack(table, with_ids=False).collect(), docs, NAMES[0], 2048)


def test_packing_edges(spark):
    schema = "doc_id bigint, text string, ids int, start string"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, None, 1, "x"), (None, None, 1, "x"), (4, "a b", 2, None)], schema).coalesce(1))
    assert sorted((r.doc_id is None, r.length, r.doc_tokens) for r in rows.collect()) == [(False, 1, 3), (False, 2, 3), (True, 1, 1), (True, 1, 1)] or rows.agg({"length": "sum"}).first()[0] == 5


def brute_level(counts, n, size):
    best = None
    for h in range(size - n + 1):
        if h and not counts[h]:
            continue
        after = dict(enumerate(counts))
        after[h] -= h > 0
        after[h + n] += 1
        score = sum(v * v for level, v in after.items() if 0 < level < size)
        if best is None or score <= best[0]:
            best = (score, h)
    return best[1]


def test_levels_follow_the_sum_of_squares():
    rng = random.Random(5)
    levels = packing.Levels(32)
    for _ in range(600):
        n = rng.randrange(1, 32)
        counts = levels.counts.tolist()
        h = levels.choose(n)
        want = brute_level(counts, n, 32)
        assert h == want
        levels.place((None, 0, b"\0" * 4 * n), n)
        assert levels.counts[0] == 0 and levels.counts[32] == 0
        assert [len(w) for w in levels.windows] == levels.counts[:32].tolist()


def test_token_files_round_trip(spark, tmp_path):
    rng = random.Random(1)
    texts = [*EDGE, *(" ".join(rng.choice(["Ab", "cd", "é"]) for _ in range(rng.randrange(50))) for _ in range(200))]
    docs = [(i * 7 - 50, t) for i, t in enumerate(texts)] + [(None, "no id"), (20, "again"), (20, "again")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, path string, file_no int").repartition(5)
    files = token_file.write_token_files(df, str(tmp_path / "out"))
    rows = sorted(token_file.read_token_files(files).collect(), key=lambda r: r.start)
    known = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in known]
    want = {d: plain(NAMES[1], [t])[0] for d, t in docs if d not in (20, None)}
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id in want:
            assert (r.n_tokens, r.ids_crc32) == (len(want[r.doc_id]), zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes()))
    some = spark.createDataFrame([(-50,), (-43,), (99_999,), (-43,)], "doc_id bigint")
    assert {r.doc_id: r.ids for r in token_file.read_documents(files, some).collect()} == {d: want[d] for d in (-50, -43)}


def test_token_file_detects_damage_and_is_seekable_zstd(tmp_path):
    import zstandard

    path = tmp_path / "f.zst"
    with open(path, "wb") as f:
        w = token_file.Writer(f)
        for d, ids in ((5, [1, 2, 3]), (None, []), (9, [7] * 100)):
            w.add(d, np.array(ids, "<u4").tobytes())
        w.finish()
    raw = path.read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert np.frombuffer(whole, "<u4").tolist() == [1, 2, 3, *[7] * 100]
    reader = token_file.open_reader(str(path))
    assert reader.doc_ids == [5, None, 9] and reader.read(1) == b""
    assert np.frombuffer(reader.read(2), "<u4").tolist() == [7] * 100
    at = int(reader.positions[0]) + 11
    path.write_bytes(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
    with pytest.raises(Exception):
        token_file.open_reader(str(path)).read(0)
    path.write_bytes(b"plain bytes, long enough")
    with pytest.raises(ValueError):
        token_file.open_reader(str(path))


def test_token_files_of_nothing(spark, tmp_path):
    files = token_file.write_token_files(spark.createDataFrame([], "doc_id bigint, text string"), str(tmp_path / "o"))
    assert token_file.read_token_files(files).count() == 0
