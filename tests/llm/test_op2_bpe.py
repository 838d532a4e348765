import hashlib
import random

import pytest
from tokenizers import Tokenizer

from engramma.llm import op2_bpe as m

ODD = ["", " \t\n", "Hello World's we'll  I'M", "ÉTÉ Straße ΑΣ ΣΑΣ", "a<|endoftext|>b <|startoftext|>", "x" * 30000, "ab" * 9000 + "!", "İstanbul ǅ ﬁ", "éé Å",
       "日本語テキスト 1234 ٣٤", "a b\u0085c d\x1ce\x1ff", "\U0001f600\U0001f680 ok", "don't DON'T 'Tis", "###***$$$", "​­", "i̇"]


@pytest.fixture(scope="module")
def pair():
    return m.tokenizer(m.default_path()), Tokenizer.from_file(m.default_path())


def test_equals_library(pair):
    mine, theirs = pair
    rng = random.Random(5)
    alphabet = "abcdeéèüßABC'  \n.,!?0123-_#*ñçΣ 日"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    texts += ["".join(rng.choice("thein") for _ in range(12000)) for _ in range(3)]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids, t[:60]
        text = theirs.decode(ids, skip_special_tokens=False)
        assert mine.decode(ids) == text
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert mine.digest(t) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_transducer_small_blocks(pair):
    mine, _ = pair
    rng = random.Random(6)
    assert mine.merges.lookahead < 2000
    for _ in range(6):
        word = "".join(rng.choice("aeinrsth") for _ in range(6000))
        symbols = [mine.inner[b] for b in word.encode()]
        machine, out, most = m.Transducer(mine.merges, 16), [], 0
        for i in range(0, len(symbols), 7):
            out += machine.push(symbols[i : i + 7], mine.spans)
            most = max(most, len(machine.pending))
        assert out + machine.finish() == mine.merges.encode(symbols)
        assert most <= 16 + 2 * mine.merges.lookahead + 7


def test_slices_and_long_words(pair):
    mine, theirs = pair
    rng = random.Random(8)
    long = "".join(rng.choice("aeinrsthé") for _ in range(5000))
    texts = ["a b" * 50000, long + " x " + long, "\u0301 e\u0301" * 30000, "日本語" * 40000, "!" * 70000 + " " * 70000 + "end", "ΑΣ ΣΑΣ " * 12000, ("w" * 70000 + "<|endoftext|>") * 2]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids, t[:40]
        assert "".join(m.slices(t, 1000)) == t
    assert max(map(len, m.slices("a b" * 50000))) <= m.SLICE
    assert [i for part in mine.word(long) for i in part] == mine.merges.encode([mine.inner[b] for b in long.encode()[:-1]] + [mine.final[long.encode()[-1]]])
    assert len(list(mine.word(long))) > 2 and mine.machine.pending == []


def test_byte_to_text_at_any_cut():
    raw = "aé日\U0001f600z".encode() + b"\xff\xe2\x82"
    for step in (1, 2, 3, 5):
        machine = m.ByteToText()
        got = "".join(machine.push(raw[i : i + step]) for i in range(0, len(raw), step)) + machine.finish()
        assert got == raw.decode("utf-8", "replace")


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, "Hi", 7), (3, "Hi", 7), (3, "Hi", 7)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in m.bpe_digest(docs, m.default_path()).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert m.bpe_digest(docs.limit(0), m.default_path()).count() == 0


def test_full_table(spark, pair):
    sf = "/root/testdata/sf0.001"
    _, theirs = pair
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, m.op2_bpe_digest(spark, sf).collect())) == sorted(want)


def test_tokens_column(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in m.bpe_tokens(docs, m.default_path()).collect()}
    model = m.tokenizer(m.default_path())
    assert got == {1: model.encode("hello world"), 2: []} and model.decode(got[1]) == "hello</w> world</w>"


def test_words_met_again_stay_in_a_full_table(monkeypatch):
    model = m.WordBpe(m.default_path())
    monkeypatch.setattr(m, "CACHE_WORDS", 8)
    packed, plain = [], model.word
    monkeypatch.setattr(model, "word", lambda w: packed.append(w) or plain(w))
    text = " ".join(f"often word{chr(97 + i)}{chr(97 + i)}" for i in range(26))
    ids = model.encode(text)
    assert packed.count("often") == 1 and len(model.cache) + len(model.older) <= 8
    monkeypatch.undo()
    assert ids == m.WordBpe(m.default_path()).encode(text)


def test_ascii_words_are_those_of_the_whole_pattern():
    model = m.tokenizer(m.default_path())
    for text in ["".join(map(chr, range(128))), "it's we'll 'sno '' don't've", "a1b22\x0b\x1c\x1d\x1e\x1f\x85c_d--e f\r\n'"]:
        text = model.normal("".join(c for c in text if c.isascii()))
        assert model.find_ascii(text) == model.find(text)
