"""Verdicts of quality and toxicity on a small table."""

import numpy as np

from seguelab.llm import classifier

DOCS = "doc_id long, text string"
FILL = "the river and a field of barley in the morning with some people on the road to that town as it was for years".split()


def prose(k, extra=()):
    words = [str(w) for w in np.random.default_rng(k).permutation(FILL * 4)]
    for j, w in enumerate(extra):
        words.insert(7 * j + 3, w)
    return "We saw " + " ".join(words) + "."


def test_fluent_toxic_texts_go(spark):
    abuse = [["idiot", "scum", "moron", "trash", "worthless"], ["pathetic", "loser", "idiot", "stupid"], ["moron", "disgusting", "clown", "scum"]]
    rows = [(k, prose(k)) for k in range(200)] + [(1000 + k, prose(500 + k, abuse[k % 3])) for k in range(30)]
    rows += [(2000, None), (2001, ""), (2002, prose(900, ["trash"])), (None, prose(901, abuse[0]))]
    got = {r.doc_id: r for r in classifier.classify(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    assert all(got[1000 + k].toxic and not got[1000 + k].keep for k in range(30)) and got[None].toxic
    assert not any(got[k].toxic for k in range(200)) and not got[2002].toxic and all(got[k].keep for k in range(200))
    assert got[2000].toxicity == got[2001].toxicity == 0 and not got[2000].keep


def test_tables_without_toxic_texts(spark):
    df = spark.createDataFrame([(k, prose(k)) for k in range(40)], DOCS)
    assert all(r.keep and not r.toxic for r in classifier.classify(df).collect())
    assert classifier.classify(df.limit(0)).count() == 0
