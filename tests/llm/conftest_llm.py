"""Invented prose for the tests."""

import random

WORDS = "the of and bright river stone cold lamp over under green paper signal quiet harbour window engine".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)) + ". "


def prose(seed, sentences=8, words=9):
    rng = random.Random(seed)
    return "".join(sentence(rng, words) for _ in range(sentences))
