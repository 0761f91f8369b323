"""Words that come early stay when the kept ones overflow, and ids are the library's all the same."""

from __future__ import annotations

from quillon.llm.common import WordIds, vocabulary


def test_early_words_stay():
    ids = WordIds(vocabulary())
    ids.KEEP, ids.LOT = 8, 1
    texts = [b"the of and in"] + [f"the word{k} other{k} again{k}".encode() for k in range(6)]
    assert list(ids.texts(texts)) == [ids.encoded(x.decode()) for x in texts]
    assert list(ids.kept)[:4] == list(dict.fromkeys(list(ids.kept)))[:4] and {b"the", b"of", b"and", b"in"} <= set(ids.kept)
