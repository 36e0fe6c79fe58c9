import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "sun", "rop", "ing", "est") for b in ("ra", "to", "nel", "is", "um", "ash")]


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n words."""

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"
