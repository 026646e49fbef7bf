"""Words know their documents and lines; hashes are put in order by a packed sort."""

import random

import numpy as np
import pyarrow as pa

from vitrine.llm import common


def test_words_know_their_documents_and_lines():
    rng = random.Random(6)
    for _ in range(40):
        docs = ["".join(rng.choice("ab \n\t") for _ in range(rng.choice([0, 1, 30]))) for _ in range(rng.randrange(1, 9))]
        for t in common.text_chunks(pa.array(docs)):
            _, a, _, doc = common.words(t)
            breaks = np.flatnonzero(t.data == 10)
            assert np.array_equal(doc, np.searchsorted(t.start, a, "right") - 1)
            assert np.array_equal(common.between(a, breaks), np.searchsorted(breaks, a))
    for h in (np.zeros(0, np.uint64), np.arange(9, dtype=np.uint64)[::-1].copy(), np.array([rng.getrandbits(64) for _ in range(500)] * 2, np.uint64)):
        assert np.array_equal(h[common.hash_order(h)], np.sort(h))
