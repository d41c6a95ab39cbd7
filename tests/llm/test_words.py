import numpy as np
import pyarrow as pa

from helpers import LONG, ODD, lower, words

from trustlens.llm.subwords import Encoder, default_path
from trustlens.llm.words import hashed_rows, shingle_set


def test_hashes_tell_words_apart_and_ignore_case():
    texts = [t for _, t, _, _ in ODD] + ["ABC abc \x1c Abc", "x" * 65 + "y" + " " + "x" * 64 + "yx", "é É"]
    seen, back = {}, {}
    for limit in (1, 50, 1 << 20):
        for a, b, _, _, _, _, bounds, h in hashed_rows(pa.array(texts), limit):
            for i in range(a, b):
                own = words(lower(texts[i]))
                got = h[bounds[i - a]:bounds[i - a + 1]].tolist()
                assert len(own) == len(got)
                for w, x in zip(own, got, strict=True):
                    assert seen.setdefault(w, x) == x and back.setdefault(x, w) == w


def test_sliced_and_null_arrays():
    col = pa.array(["a b", None, "", "c  d e"]).slice(1)
    assert [bounds.tolist() for *_, bounds, _ in hashed_rows(col)] == [[0, 0, 0, 3]]


def test_shingle_sets():
    h = np.arange(10, dtype=np.uint64)
    assert len(shingle_set(h)) == 6 and len(shingle_set(h[:4])) == 1 and len(shingle_set(h[:0])) == 0


def test_ids_equal_the_library(monkeypatch):
    from trustlens.llm import subwords
    encoder = Encoder(default_path())
    texts = [t or "" for _, t, _, _ in ODD] + [
        "İstanbul ıİ Ⅷ ﬁne été ΑΣ. naïve. it's they're I'm. (a) [b]. 1,000.50! a.b.c. ... ?! <|startoftext|>x", LONG[:5000],
        "tab\x0bvertical\x0cform\x1cgroup\x85next line", "ﬃ ẛ̣ Å", "日本語テキスト。混ぜ abc", "a" * 300 + "."]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for remembered in (10**6, 50):
        monkeypatch.setattr(subwords, "REMEMBERED", remembered)
        encoder.clear()
        for _ in range(2):
            got = [ids[bounds[i]:bounds[i + 1]].tolist() for a, b, ids, bounds in encoder.encode_rows(pa.array(texts)) for i in range(b - a)]
            assert got == want
