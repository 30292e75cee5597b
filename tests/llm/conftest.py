from __future__ import annotations

import random

import pytest

WORDS = "the of and in a to fox dog red tree stone river cloud über naïve run jump sleep word line text".split()


@pytest.fixture
def rnd():
    return random.Random(17)


@pytest.fixture
def prose(rnd):
    """A function that makes n words of prose."""
    return lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "ing", "x", "ly"]) + str(rnd.randint(0, 99)) for _ in range(n))
