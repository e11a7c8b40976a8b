"""Encoding, spans and decoding against the sentencepiece library itself."""

import hashlib
import itertools
import random

import pytest

from outways.llm import piece_spans
from outways.llm.piece_spans import CharacterMap, Pieces, fields

spm = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")

PARTS = ["a", "b", "e", " ", "  ", "▁", "é", "漢", "😀", "\n", "\0", "́", "the", "<s>", "<0x41>", " ", "�", "1", "ｶ", "ﾞ", "①", "ﬁ", "　", "A", "\t"]


def library():
    return spm.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_ids_and_spans_are_the_library_s():
    pieces, lib = Pieces(), library()
    for text in [*random_texts(800, 1), "", " ", "▁", "x" * 5000, "漢字" * 3000, " " * 900]:
        ids, starts, ends = pieces.encoded([text])[0]
        said = lib.encode(text, return_type="proto").pieces
        assert list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True)) == [(p.id, p.begin, p.end) for p in said]
        assert pieces.decoded(ids.tolist()) == lib.decode(ids.tolist())


def test_spans_meet_and_cover_the_text():
    for text in random_texts(200, 2):
        _, starts, ends = Pieces.encoded(piece_spans.pieces_of(None), [text])[0]
        assert starts.tolist()[1:] == ends.tolist()[:-1]
        assert not text or (starts[0] == 0 and ends[-1] == len(text.encode()))


def test_decoding_any_ids():
    pieces, lib, rnd = Pieces(), library(), random.Random(3)
    some = [0, 1, 2, 3, 70, 200, 229, 153, 132, 259, 260, 300, 1000, 28705, 263]
    for _ in range(800):
        ids = [rnd.choice(some) for _ in range(rnd.randint(0, 8))]
        assert pieces.decoded(ids) == lib.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_compiled_maps_with_alignment(rule):
    for flags in itertools.product((True, False), repeat=3):
        normalizer = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=flags[0], remove_extra_whitespaces=flags[1], escape_whitespaces=flags[2])
        mine = CharacterMap(dict(fields(normalizer.serialized_normalizer_spec())).get(2, b""), *flags)
        for text in random_texts(150, 4):
            out, origin = mine.mapped(text)
            char = {len(text[:i].encode()): i for i in range(len(text) + 1)}
            assert (out, [char[at] for at in origin.tolist()]) == (lambda said: (said[0], list(said[1])))(normalizer.normalize(text, with_offsets=True))


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(piece_spans, "KNOWN", 20)
    pieces, lib = Pieces(), library()
    texts = [f"word{i} of {i % 7} and word{i // 2}" for i in range(60)]
    for at in range(0, 60, 7):
        assert [ids.tolist() for ids, _, _ in pieces.encoded(texts[at : at + 7])] == lib.encode(texts[at : at + 7])


def test_query_on_odd_rows(spark):
    lib = library()
    texts = ["a  b", "", None, "x\n" * 20_000, "a  b", "漢字 ▁ 😀"]
    rows = [(i % 5, t, t, 1) for i, t in enumerate(texts)]
    got = piece_spans.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string, starts int")).collect()
    want = []
    for (doc_id, text, *_), ids in zip(rows, lib.encode([t or "" for t in texts]), strict=True):
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(ids), digest(",".join(map(str, ids))), digest(lib.decode(ids)), len((text or "").encode())))
    assert sorted(map(tuple, got)) == sorted(want)
    assert piece_spans.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stored_ids_decode(spark):
    ids = library().encode("it is 漢 here")
    rows = spark.createDataFrame([(1, ids), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in piece_spans.decoded(rows).orderBy("doc_id").collect()] == ["it is 漢 here", "", ""]
