"""Word hashes hold against patterns that cancel in polynomials, whatever their length."""

import numpy as np
import pyarrow as pa

from filigree.llm.words import SAME, text_slices, word_hashes, words


def hashed(texts, fold=SAME):
    t = next(text_slices(pa.array(texts), 1 << 30))[2]
    starts, ends, _ = words(t)
    return word_hashes(t, starts, ends, fold)


def morse(n, a, b):
    s = "0"
    while len(s) < n:
        s += s.translate(str.maketrans("01", "10"))
    return s.replace("0", a).replace("1", b)


def test_thue_morse_words_differ_from_their_mirrors():
    for n in (2, 64, 256, 512, 1024, 4096, 65536):
        for a, b in (("a", "b"), ("x", "y"), ("a" * 256, "b" * 256), ("é", "à")):
            pair = [morse(n, a, b), morse(n, b, a)]
            h = hashed([pair[0] + " " + pair[1]])
            assert h[0] != h[1], (n, a, b)
            h = hashed([("q" * 7 + p) for p in pair])
            assert h[0] != h[1]


def test_equal_words_of_all_sizes_hash_alike_and_others_do_not():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab"), n)) for n in [*range(1, 40), 255, 256, 257, 511, 512, 513, 65535, 65536, 65537, 70000] for _ in range(3)]
    texts += [t[:-1] + "c" for t in texts] + ["c" + t[1:] for t in texts if len(t) > 1] + ["a" * n for n in range(1, 1500)]
    alone, together = [hashed([t])[0] for t in texts], hashed([" ".join(texts)])
    assert (np.array(alone) == together).all()
    assert len(set(alone)) == len(set(texts))
