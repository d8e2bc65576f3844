"""The one path of a byte-pair model is found by few tries."""

import random

from tidemark.llm import wfst


class Counted(dict):
    tries = 0

    def get(self, *key):
        Counted.tries += 1
        return super().get(*key)

    def __contains__(self, key):
        Counted.tries += 1
        return super().__contains__(key)


def test_one_path_takes_few_tries():
    machine = wfst.Transducer(open(wfst.MODEL, "rb").read())
    rng = random.Random(3)
    known = [p for p in machine.pieces.weights if p.isascii() and p.isalpha()]
    texts = ["".join(rng.choice(known) for _ in range(4)) for _ in range(300)] + ["", "x", "\u0007", "aaaaaaaaaaaaaaaaa", "一b�"]
    machine.pieces.weights = Counted(machine.pieces.weights)
    found = [wfst.only_path(t, machine.pieces, machine.order) for t in texts]
    assert [path for _, path in found] == [machine.order.merged(t) for t in texts]
    assert Counted.tries < 2 * sum(map(len, texts))


def test_dead_ends_are_left():
    rng = random.Random(5)
    for _ in range(200):
        score = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))): -float(k) for k in range(12)}
        order = wfst.MergeOrder(score)
        pieces = wfst.Pieces({p: 0.0 for p in score if order.merged(p) == [p]})
        for _ in range(20):
            text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 25)))
            weight, path = wfst.only_path(text, pieces, order)
            assert path == order.merged(text) and weight == 10.0 * sum(p not in pieces.weights for p in path)
