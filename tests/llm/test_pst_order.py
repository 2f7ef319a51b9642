"""The suffix tree's questions are ordered by one sort of whole numbers."""

import numpy as np

from cellguard.llm import pst as P


def test_entries_are_sent_in_the_order_of_a_stable_sort_without_one(monkeypatch):
    texts = [b"a b a b c a b", b"a b c d", b"c d a b a b"] * 8
    parts = 4
    trains = P.by_crc(2, 7)
    tokens, asked = P.tokenise(list(range(len(texts))), texts, trains, parts)
    told, found = {}, []
    for p, sent in asked.items():
        answers, known = P.merge_words([sent, sent], parts)  # as if another block held the same words
        told[p] = answers[0]
        found.append(known)
    model = P.Model(int(sum(f["n"][0] for f in found)), int(sum(f["v"][0] for f in found)), parts)

    def refused(*args, **kwargs):
        raise AssertionError("argsort")

    block = P.Tokens(*tokens)
    monkeypatch.setattr(P.np, "argsort", refused)
    places = P.Places(block, model, [told])
    monkeypatch.undo()
    assert len(places.sent) > 4
    again = np.argsort(places.pair, kind="stable")
    assert (again == np.arange(len(again))).all()  # by pair, and by place within a pair
    assert all(np.diff(places.sent[places.pair == q]).min(initial=1) > 0 for q in set(places.pair.tolist()))
    assert sorted(places.sent.tolist()) == np.nonzero(~places.own)[0].tolist()
    assert (places.pair_context[places.pair] == places.of[places.sent]).all()
