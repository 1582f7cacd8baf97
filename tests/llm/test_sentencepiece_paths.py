"""Pre-tokens read together against one reading of the whole text."""

import random

import numpy as np

from velotrace.llm import sentencepiece


def test_joint_reading_against_whole_texts():
    vocabulary = sentencepiece.load()
    e = sentencepiece.Encoder(vocabulary)
    rng = random.Random(17)
    some = rng.sample(sorted(vocabulary.pieces), 400)
    texts = ["", " ", "a", "...", " , 12.5%%% (x)", "x\n\n .y", "1,000.00-2", "\U0001f600a.b", "a" * 300 + "." * 300]
    texts += ["".join(rng.choice([*some, " ", ".", ",", "7", "-", "'", "\n", "é", "字"]) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    for text, (ids, n_bytes, score) in zip(texts, e.encode(texts), strict=True):
        marked = sentencepiece.MARK + text.replace(" ", sentencepiece.MARK)
        want = np.frombuffer(e.viterbi(marked).tobytes(), np.int32) if text else np.zeros(0, np.int32)
        assert np.array_equal(ids, want)
        assert (n_bytes, score) == (int(vocabulary.is_byte[want].sum()), float(vocabulary.scores[want].sum()))


def test_paths_of_many_words_in_one_reading():
    e = sentencepiece.Encoder(sentencepiece.load())
    words = ["▁the", "▁", "a", "▁of,", "the" * 90]
    assert e.paths(words) == [e.viterbi(w).tobytes() for w in words] and e.paths([""]) == [b""]
