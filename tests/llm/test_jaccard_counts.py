from collections import Counter

import numpy as np

from lodestream.llm import jaccard


def test_counts_are_of_all_documents(spark, monkeypatch):
    texts = [f"all hold this line here {i} w{i % 4000} x{i % 2500} y" for i in range(9000)]
    docs = spark.createDataFrame([*enumerate(texts), (9000, None), (9001, "")], "doc_id long, text string").repartition(5)
    want = Counter(int(h) for t in texts for h in jaccard.shingles(t, 2))
    want = {h: n for h, n in want.items() if n >= jaccard.FREQUENT}
    for combine in (1 << 20, 500):
        monkeypatch.setattr(jaccard, "COMBINE", combine)
        h, n = jaccard.frequent(docs, 2)
        assert (np.diff(h.astype(object)) > 0).all()
        assert dict(zip(h.tolist(), n.tolist())) == want
    monkeypatch.setattr(jaccard, "MOST", 7)
    h, n = jaccard.frequent(docs, 2)
    assert sorted(n.tolist()) == sorted(want.values())[-7:]


def test_no_documents_no_counts(spark):
    h, n = jaccard.frequent(spark.createDataFrame([], "doc_id long, text string"), 5)
    assert len(h) == len(n) == 0
