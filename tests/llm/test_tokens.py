import public_tokenizers
from tokenizers import Tokenizer

from filigree.llm.tokens import TokenCounter, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "x" * 4000, "a<|endoftext|>b " * 300, "é́ß" * 1500, " " * 3000, "it's we'll " * 400, "ab c d\x1ce " * 300, "Straße 12 Ünïted   x" * 200, "word " * 2000]


def test_chunks_and_words_against_the_library():
    spec = open(PATH, encoding="utf-8").read()
    tok = Tokenizer.from_str(spec)
    c = TokenCounter(spec, chunk=256, overlap=8)
    for t in TEXTS:
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert c.count_chunked(t) == n and c.count_words([t.encode()]) == [n]
    assert c.widened > 0


def test_rows(docs, rows, none):
    tok = Tokenizer.from_file(PATH)
    want = sorted((r[0] or -1, len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    out = token_counts(docs, PATH).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in out) and any(r.over_limit for r in out)
    assert token_counts(none, PATH).count() == 0
