import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopsmith.llm import packing, token_planes
from shopsmith.llm.bpe_prefix import PrefixCodec, encode_documents
from shopsmith.llm.queries import tokenizer_file
from shopsmith.llm.tokens import PartEncoder, load_tokenizer

ODD = ["", " ", "a  b", "\n a", "a \n b", "x\n", "\nx y", "x \n\n y", "a\nB. c\n(d)", "a\tb c", " <|endoftext|> b<|endoftext|> c",
       "<|startoftext|>x<|STARToftext|>", "é x", "a b", "a\x1c b", "don't DON'T 12 345", "ΣΑΣ İ", "Ⅷ 한글 日本。",
       "aaaaaaaaaaaaaaaaaaaa!!!!!!!! ----", "µ × ß ẞ 'Re x's"]
TEXT = st.text(st.sampled_from("abCé ß.,!'\n\t 1<|>"), max_size=60)
FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
_CACHE = {}


def _pair(name, keeps):
    if name not in _CACHE:
        path = tokenizer_file(name)
        _CACHE[name] = load_tokenizer(path), PartEncoder(path, keeps)
    return _CACHE[name]


@pytest.mark.parametrize("name,keeps", FILES)
@settings(max_examples=150, deadline=None)
@given(text=TEXT)
def test_parts_give_the_whole_texts_ids(name, keeps, text):
    tok, enc = _pair(name, keeps)
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name,keeps", FILES)
def test_odd_texts(name, keeps):
    tok, enc = _pair(name, keeps)
    for t in ODD:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@settings(max_examples=150, deadline=None)
@given(text=TEXT)
def test_prefix_bpe_is_the_tokenizers_bpe(text):
    if "codec" not in _CACHE:
        _CACHE["codec"] = PrefixCodec(tokenizer_file("word_bpe_49k.json"))
    tok, _ = _pair("word_bpe_49k.json", False)
    for t in [text, *ODD]:
        ids, decoded = _CACHE["codec"].encode(t)
        want = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == tok.decode(want, skip_special_tokens=False)


ROWS = [(3, "b c " * 3000, 1), (1, None, 2), (None, "x y", 3), (2, "", 4), (3, "b c", 5), (3, "b c", 6), (9, "Hello there. " * 40, 7)]
SCHEMA = "doc_id long, text string, n_tokens int"


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    for ids in ([], [0], [5, 70000, 3], list(range(1000))):
        a = np.array(ids, "<u4")
        assert token_planes.from_planes(token_planes.to_planes(a, kind), len(a), kind).tolist() == ids


def test_token_files_round_trip(spark, monkeypatch):
    path = tokenizer_file("byte_bpe_50k.json")
    tok = load_tokenizer(path)
    got = token_planes.token_file_digests(spark.createDataFrame(ROWS, SCHEMA), path, True, 0).collect()
    assert len(got) == len(ROWS)
    at = 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r, g in zip(order, sorted(got, key=lambda r: r["start"])):
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        assert (g["doc_id"], g["start"], g["n_tokens"]) == (r[0], at, len(ids))
        assert g["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_documents_across_blocks(spark, tmp_path):
    path, out = tokenizer_file("byte_bpe_50k.json"), str(tmp_path / "planes")
    token_planes.write_token_files(spark.createDataFrame(ROWS, SCHEMA), out, path, True, 0, kind="bit", block_ids=64)
    pieces = token_planes.read_token_files(spark, out, kind="bit").collect()
    texts = {}
    for p in sorted(pieces, key=lambda p: (p["shard"], p["row"], p["at"])):
        texts.setdefault((p["shard"], p["row"], p["doc_id"]), []).append(bytes(p["ids"]))
    tok = load_tokenizer(path)
    want = sorted(np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for r in ROWS)
    assert sorted(b"".join(v) for v in texts.values()) == want
    starts = [r["start"] for r in token_planes.chunk_index(spark, out).orderBy("start").collect()]
    sizes = [r["n_ids"] for r in token_planes.chunk_index(spark, out).orderBy("start").collect()]
    assert starts == [sum(sizes[:k]) for k in range(len(sizes))]


def test_checksums_of_cut_documents(spark, tmp_path):
    path, out = tokenizer_file("byte_bpe_50k.json"), str(tmp_path / "planes")
    token_planes.write_token_files(spark.createDataFrame(ROWS, SCHEMA), out, path, True, 0, block_ids=64)
    read = token_planes.read_digests(spark, out)
    tok = load_tokenizer(path)
    want = [tok.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in ROWS]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in read.collect()) == sorted(
        (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in want)
    for a, b in ((b"", b"x"), (b"ab", b""), (b"abc", b"d" * 1000)):
        assert token_planes.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_a_known_word_is_not_tokenized_again_with_its_marks():
    enc = PartEncoder(tokenizer_file("byte_bpe_50k.json"), True)
    asked, ids = [], enc._ids
    enc._ids = lambda pieces: asked.append(pieces) or ids(pieces)
    enc.encode("x thonst thonst, thonst. élan élan!")
    assert asked == [["x"], [" thonst"], [","], ["."], [" élan"], ["!"]]


def test_encode_documents_edge_rows(spark):
    got = encode_documents(spark.createDataFrame(ROWS, SCHEMA), tokenizer_file("word_bpe_49k.json")).collect()
    assert len(got) == len(ROWS) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert encode_documents(spark.createDataFrame([], SCHEMA), tokenizer_file("word_bpe_49k.json")).count() == 0
    assert hashlib.sha256(b"").hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_decreasing_against_a_plain_scan(lengths):
    bins = packing.best_fit_decreasing(lengths, 64)
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit, key=lambda k: room[k])] -= n
        else:
            room.append(64 - n)
    assert sorted(sum(lengths[k] for k in b) for b in bins) == sorted(64 - r for r in room)
    closed = packing.close_windows([[(k, 0, lengths[k]) for k in b] for b in bins], 64, small_gap=2)
    seen = {}
    for b in closed:
        total = sum(p[2] for p in b)
        assert total <= 64 and (total >= 62 or total & (total - 1) == 0)
        for k, start, n in b:
            seen.setdefault(k, []).append((start, n))
    for k, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[k]):
            assert start == at
            at += size
        assert at == n


def test_packing_covers_every_id(spark):
    path = tokenizer_file("word_bpe_49k.json")
    tok = load_tokenizer(path)
    got = packing.pack_documents(spark.createDataFrame(ROWS, SCHEMA), path, False, 1, batch_ids=500).collect()
    lengths = {}
    for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == lengths.get(p["sequence_id"], 0) and len(p["ids"]) == 4 * p["length"]
        lengths[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(lengths.values()) <= 2048
    total = sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)
    assert sum(lengths.values()) == total
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), path, False).count() == 0


def test_many_adjacent_special_tokens():
    path = tokenizer_file("word_bpe_49k.json")
    tok, codec = load_tokenizer(path), PrefixCodec(path)
    for text in ("<|endoftext|>" * 5000, "a" + "<|endoftext|>b<|startoftext|>" * 2500 + "é x"):
        ids = np.frombuffer(codec.encode(text)[0], "<u4").tolist()
        assert ids == tok.encode(text, add_special_tokens=False).ids and len(ids) >= 5000
