import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from helpers import EDGES, SMALL, documents, multiset, sha

from chorale.llm import bpe_chunks
from chorale.llm.queries import QUERIES

TRICKY = [
    "don't 's<|endoftext|>y <|startoftext|> " * 200, "é́ á  b c " * 900, "\x1c\x1d a\x85b " * 1500, "日本語" * 3000,
    "'s" * 4000, "no<|endof" + "x" * 3000 + "text|> blank", " lead and trail ", "A" * 40_000, "🙂 ' s" * 700,
]

CODECS = {}


def by_library(texts):
    tok = bpe_chunks.tokenizer(bpe_chunks.default_path())
    for text in texts:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        yield ids, tok.decode(ids, skip_special_tokens=False)


def test_chunks_give_the_librarys_ids():
    codec = bpe_chunks.Codec(bpe_chunks.default_path())
    texts = TRICKY + [t for _, t in EDGES if t] + TRICKY
    for text, (ids, decoded) in zip(texts, by_library(texts)):
        got, piece = codec.encode(text)
        assert np.frombuffer(got, np.int32).tolist() == ids
        assert piece == decoded


SHAPES = [
    "Don't DON'T we'LL o'clock ''s 'S x's't", "a\u0301 A\u030a E\u0301cole \u0130stanbul \u0130\u0307 \u01c4 \u01c5 \u0149 \u1e9e \u017f \u0345a", "Élan, «Étude» (Größe) ÀÉÎ!? ¿Qué? 10²½ ªº",
    "ABC123def--x_y__z #a1 $5.00 a1B2 <b>x</b> a<b <|endoftext|> <|ENDOFTEXT|>", "x\x1cy \x1d\x7f a\x00b a\x85b a\u00a0b \u2028 \u200b c\u00adc", "ΑΣ. ΣΑΣ ΑΣ.x Я й\u0306 日本x",
]


def test_words_are_cut_as_the_library_cuts_them():
    codec = bpe_chunks.Codec(bpe_chunks.default_path())
    assert codec.model is not None and codec.by_word
    words = list(dict.fromkeys(w for s in SHAPES + TRICKY for w in s.split(" ") if w and not w.isspace()))
    words += [a + w + b for w in ("Ab", "é", "É9", "9", "²", "\u0301") for a in ("(", "é", "'", "_", "") for b in (").", "'s", "ß", "é,", "")]
    words = [w for w in dict.fromkeys(words) if len(w.encode().split()) == 1 and w.encode().split()[0] == w.encode()]
    got = codec._word_parts([w.encode() for w in words])
    for word, (ids, decoded), (want, text) in zip(words, got, by_library(words)):
        assert np.frombuffer(ids, np.int32).tolist() == want and decoded == text, word
    assert sum(bpe_chunks.pretokens(w.encode()) is not None for w in words) > 40
    assert bpe_chunks.pretokens("Größe,".encode()) == ("größe".encode(), b",") and bpe_chunks.pretokens(b"don't") is None


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), st.sampled_from("aAbé '.,-1<|\u0301\u0307 \n")), max_size=60))
def test_any_text_gives_the_librarys_ids(text):
    codec = CODECS.setdefault("one", bpe_chunks.Codec(bpe_chunks.default_path())) if "one" not in CODECS else CODECS["one"]
    (ids, decoded), = by_library([text])
    got, piece = codec.encode(text)
    assert np.frombuffer(got, np.int32).tolist() == ids and piece == decoded


def test_failed_joins_widen_step_by_step():
    """A codec whose word store holds wrong ids of some words repairs the joins beside them."""
    words = [f"plain{i * 7919 % 10007}" for i in range(3000)]
    text = " ".join(words)
    (ids, decoded), = by_library([text])
    codec = bpe_chunks.Codec(bpe_chunks.default_path())
    ends = bpe_chunks.cuts(text.encode())
    border = text.encode()[: ends[0]].split()[-2]  # the last inner word of the first chunk
    codec.words.put(border, (np.array([5, 6], np.int32).tobytes(), "wrong"))
    seen = []
    widened = codec._widened
    codec._widened = lambda *a: seen.append(widened(*a)) or seen[-1]
    got, piece = codec.encode(text)
    assert seen and seen[0][0] == 1 and np.frombuffer(got, np.int32).tolist() == ids and piece == decoded


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    codec = bpe_chunks.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    assert not codec.by_word
    for text in ["Some words, and  more\n words", "x", ""]:
        ids = codec.tok.encode(text, add_special_tokens=False).ids
        got, piece = codec.encode(text)
        assert np.frombuffer(got, np.int32).tolist() == ids and piece == codec.tok.decode(ids, skip_special_tokens=False)


def test_shared_chunks_are_encoded_once():
    passage = " ".join(f"passage{i * 7919 % 10007}" for i in range(4000))
    codec = bpe_chunks.Codec(bpe_chunks.default_path())
    codec.encode("first text " + passage)
    once = codec.encoded_bytes
    codec.encode("quite another beginning of it " + passage + " and end")
    assert codec.encoded_bytes - once < 400


def test_cuts_follow_content_and_characters():
    raw = "".join(f"ä{i * 31 % 997} " for i in range(20_000)).encode()
    ends = bpe_chunks.cuts(raw)
    assert ends[-1] == len(raw) and ends == sorted(set(ends))
    for a, b in zip([0, *ends], ends):
        raw[a:b].decode()
    shifted = bpe_chunks.cuts(b"some words before " + raw)
    assert len({e - 18 for e in shifted} & set(ends)) > 0.9 * len(ends)


def test_edge_rows_and_empty_table(spark):
    docs = documents(spark, EDGES)
    got = bpe_chunks.digests(bpe_chunks.encoded(docs)).collect()
    want = [
        (d, len(ids), sha(" ".join(map(str, ids))), sha(text))
        for (d, _), (ids, text) in zip(EDGES, by_library([t for _, t in EDGES]))
    ]
    assert multiset(got) == multiset(want)
    assert bpe_chunks.digests(bpe_chunks.encoded(docs.limit(0))).collect() == []


def test_query_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: sha(" ".join(map(str, ids))) for r, (ids, _) in zip(rows, by_library([r.text for r in rows]))}
    assert {r.doc_id: r.ids_sha256 for r in QUERIES["op1_bpe"](spark, SMALL).collect()} == want
