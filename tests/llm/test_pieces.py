"""Pieces of payslip texts and their spans against the SentencePiece library."""

import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor, sentencepiece_model_pb2

from paysheaf.llm import pieces, records

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PAYSLIP = ["Salário Base  220,00  3.000,00", "INSS   11,00 330,00\nTotal de Proventos 3.000,00", "Competência: 04/2017", "▁▁13º SALÁRIO", "", " "]


def texts(seed=1, n=300):
    rng = random.Random(seed)
    letters = " ▁ \n\tab#$é😀éﬁＡ①　 ​Å가각\x00thehein  ..かが゛̀"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(n)]
    return made + PAYSLIP + ["   ", "a" * 5000, "ab" * 40, "Salário " * 500, " começo", "fim  ", "<s> </s> <0x41> <unk>", "▁x"]


def compare(path, sample):
    library, coder = SentencePieceProcessor(model_file=path), pieces.PieceCoder(pieces.PieceModel(path))
    for text, got in zip(sample, coder.encode(sample)):
        want = library.encode(text, return_type="proto").pieces
        ids = [int(i) for i in got.printed.split(",") if i]
        # the library's offsets count characters, its spans are texts: ours are bytes
        spans = [text.encode()[a:b].decode() for a, b in zip(got.starts.tolist(), got.ends.tolist())]
        assert ids == [p.id for p in want] and spans == [p.surface for p in want], text
        assert got.decoded == library.decode(ids), text


def test_pieces_and_spans_equal_the_library():
    compare(MODEL, texts())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("in_bytes", [True, False])
def test_compiled_character_maps(tmp_path, rule, prefix, squeeze, in_bytes):
    """The same pieces behind the library's own character maps."""
    spec, given = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        spec.ParseFromString(file.read())
    given.ParseFromString(SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    spec.normalizer_spec.precompiled_charsmap = given.normalizer_spec.precompiled_charsmap
    spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces = prefix, squeeze
    spec.trainer_spec.byte_fallback = in_bytes
    for p in spec.pieces:
        if p.type == pieces.BYTE and not in_bytes:
            p.type = pieces.CONTROL
    path = tmp_path / "mapped.model"
    path.write_bytes(spec.SerializeToString())
    compare(str(path), texts(2))


def test_encoded_pages_round_trip(spark):
    pages = [("a", i + 1, t) for i, t in enumerate(PAYSLIP)] + [("b", 1, None), ("c", 1, ""), ("d", 1, "Vale Transporte 😀\x01")]
    docs = records.document_text(spark.createDataFrame(pages, "doc_id string, page int, text string"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    coded = pieces.encoded(docs.union(docs), MODEL)
    library = SentencePieceProcessor(model_file=MODEL)
    got = coded.collect()
    assert sorted(r["doc_id"] for r in got) == sorted([*text, *text])
    for r in got:
        want = library.encode(text[r["doc_id"]])
        assert r["ids"] == want and r["decoded"] == library.decode(want)
        assert [0, *r["ends"]] == [*r["starts"], len(text[r["doc_id"]].encode())]
    assert [r["ids"] for r in got if r["doc_id"] in "bc"] == [[]] * 4
    rows = pieces.spans(coded).where("doc_id = 'd'").distinct().orderBy("piece_ord").collect()
    assert "".join(text["d"].encode()[r["start"] : r["end"]].decode() for r in rows) == text["d"]


def test_digests(spark):
    sample = [(i, t) for i, t in enumerate(texts(3, 40))] + [(9000, None), (None, "sem número"), (9000, None)]
    docs = spark.createDataFrame(sample, "doc_id bigint, text string").repartition(3)
    library = SentencePieceProcessor(model_file=MODEL)
    got = pieces.digests(docs, MODEL).collect()
    want = []
    for i, t in sample:
        ids = library.encode(t or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        want.append((i, len(ids), *digests, len((t or "").encode())))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))


def test_other_models_are_refused(tmp_path):
    spec = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        spec.ParseFromString(file.read())
    spec.pieces[300].type = 4
    (tmp_path / "own.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceModel(str(tmp_path / "own.model"))
