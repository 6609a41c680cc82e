"""What the driver holds while it learns quality."""

import numpy as np

from tidemark.llm import quality


def test_texts_are_let_go_as_they_become_buckets(monkeypatch):
    texts = ["plain words in a row", "buy buy buy now", "", "more plain words"]
    left = []
    grams = quality.grams
    monkeypatch.setattr(quality, "grams", lambda t: left.append(len(texts)) or grams(t))
    model = quality.fit(texts, [1, 0, 0, 1], 0.5)
    assert left == [3, 2, 1, 0] and texts == []
    assert quality.score(model, "plain words") > quality.score(model, "buy now")
    assert np.count_nonzero(model["table"]) > 10
