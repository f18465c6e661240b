import hashlib
import random

from heatlattice.llm import bpe, queries


def brute(text):
    coder = bpe.encoder(*queries.tokenizer())
    ids = coder.encode_ordinary(text or "")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return len(ids), sha(",".join(map(str, ids)).encode()), sha(coder.decode_bytes(ids))


def test_chunks_and_edge_cases(spark, docs):
    random.seed(5)
    pieces = ["the ", "don't", "we'll ", "  \n\n ", "123 456", "...!? ", "élève ", "Ünïcode", "日本語", "😀 ", "\t", "x" * 9, "a b c"]
    texts = ["".join(random.choices(pieces, k=k)) for k in (1, 5, 40, 300, 900, 900)]
    texts += [None, "", " " * 700, "x" * 1500, "a\u00a0b" * 400, texts[-1], "é" * 3, "</s> <|endoftext|>"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    out = bpe.encode(docs(rows), *queries.tokenizer(), chunk=150, overlap=60).collect()
    expect = sorted((str(i), *brute(t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == expect
    assert out and [r.decoded_sha256 for r in out if r.doc_id == 10] == [hashlib.sha256(texts[10].encode()).hexdigest()]


def test_blanks_and_new_letters_at_the_cut(spark, docs):
    """Runs of two blanks that end at, before and behind a border of chunks, before a letter, at the real chunk size."""
    blanks = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0\u1680\u2000\u2003\u2009\u200a\u2028\u202f\u205f\u3000"
    filler = "one two, three "
    rows = []
    for first in " \n\u2003":
        for last in blanks:
            for shift in (-1, 0, 1):
                head = (filler * 3000)[: bpe.CHUNK - 2 + shift].rstrip() + "x"
                head += "y" * (bpe.CHUNK - 2 + shift - len(head))
                rows.append((len(rows), head + first + last + "letters " + filler * 100))
    for new in "\u0558\u088f\U000323b0\U00011de0":  # letters and digits of some Unicode versions only
        rows.append((len(rows), (f"a{new} {new}b{new}! 1{new} {new}{new}" * 4000)[: bpe.CHUNK + 3000]))
        rows.append((len(rows), "word " * 6000 + new * 4000 + " word" * 500))
    out = bpe.encode(docs(rows), *queries.tokenizer()).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == [(i, *brute(t)) for i, t in rows]


def test_random_blanks_at_small_chunks(spark, docs):
    random.seed(8)
    pieces = [" ", "\n", "\t", "\xa0", "\u2003", "\x85", "a", "bc", "'s", "'", "!", "7", "é", "日", "\x1c", "\u088f"]
    rows = [(i, "".join(random.choices(pieces, k=random.randint(50, 400)))) for i in range(1500)]
    out = bpe.encode(docs(rows), *queries.tokenizer(), chunk=64, overlap=40).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == [(i, *brute(t)) for i, t in rows]


def test_long_texts_are_stitched_not_encoded_whole(spark, docs):
    random.seed(6)
    text = " ".join("".join(random.choices("abcdefgh", k=random.randint(1, 9))) for _ in range(3000))
    chunks = spark.createDataFrame([("k", i, text[i * 2000 : i * 2000 + 2400]) for i in range(1 + (len(text) - 1) // 2000)], "key string, i int, text string")
    cuts = bpe.stitches(chunks, queries.tokenizer()[1], 2000, 400).collect()
    assert cuts and all(r.cut is not None and r.i * 2000 <= r.cut < r.i * 2000 + 400 for r in cuts)


def test_empty_table(docs):
    assert bpe.encode(docs([]), *queries.tokenizer()).collect() == []
