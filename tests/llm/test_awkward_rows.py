"""Null ids, ties and plain decoders of operators whose other tests leave them out."""

import base64
import hashlib
import math

import numpy as np

from emberline.llm import langid, warc


def test_archives_with_null_page_ids(spark):
    rows = [(None, "http://h/0", "same"), (3, "http://h/3", "same"), (5, "http://h/5", "same"), (5, "http://h/5b", "same"),
            (None, "http://h/1", "only null"), (None, "http://h/2", "only null"), (7, None, None), (8, "http://h/8", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(((r.page_id is None, r.page_id or 0, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(warc.write_archives(pages)).collect()), key=str)

    def digest(text):
        return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()

    same, only, empty = digest("same"), digest("only null"), digest("")
    want = [(True, 0, same, "revisit", 5), (False, 3, same, "revisit", 5), (False, 5, same, "response", None), (False, 5, same, "response", None),
            (True, 0, only, "response", None), (True, 0, only, "response", None), (False, 7, empty, "revisit", 8), (False, 8, empty, "response", None)]
    assert got == sorted(want, key=str)


def test_decoding_against_a_plain_loop():
    rng = np.random.default_rng(4)
    code = rng.choice([-1.0, 1.0], (6, 15))
    model = langid.Model([f"l{i}" for i in range(6)], code, np.zeros((1, 15)), rng.uniform(0.1, 2, (6, 15)))
    answers = rng.uniform(-8, 8, (50, 15))
    best, score, ambiguous = model.decode(answers)
    for t in range(50):
        loss = [sum(model.trust[c, b] * math.log1p(math.exp(-code[c, b] * answers[t, b])) for b in range(15)) for c in range(6)]
        share = math.exp(-min(loss)) / sum(math.exp(-x) for x in loss)
        assert best[t] == loss.index(min(loss)) and abs(score[t] - share) < 1e-9 and ambiguous[t] == (share < langid.AMBIGUOUS)


def test_a_tie_goes_to_the_first_language_and_is_ambiguous():
    model = langid.Model(["a", "b"], np.array([[1.0, -1.0], [-1.0, 1.0]]), np.zeros((1, 2)), np.ones((2, 2)))
    best, score, ambiguous = model.decode(np.zeros((1, 2)))
    assert (best[0], score[0], ambiguous[0]) == (0, 0.5, True)
