"""Invented prose for fixtures."""

import random


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["river", "stone", "light", "Über", "gate", "and", "the", "walk", "green", "tall"]) + str(rng.randrange(40)) for _ in range(n))
