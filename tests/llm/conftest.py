import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows: near copies, exact copies, shared passages, ties, odd and empty texts."""
    pick = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    sentence = lambda n: [pick.choice(words) for _ in range(n)]
    passage = sentence(60)
    texts = ["", None, "one", "one two three", "One TWO three", "one two three four five", " \t\n ", "ä ö ü", "x" * 5000, "la " * 3000]
    for _ in range(12):
        base = sentence(pick.randint(20, 200))
        texts.append(" ".join(base))
        for changes in (0, 1, 2, 4, 8, 16):
            copy = list(base)
            for _ in range(changes):
                copy[pick.randrange(len(copy))] = pick.choice(words)
            texts.append("\n".join(" ".join(copy[k : k + 12]) for k in range(0, len(copy), 12)))
        texts.append(" ".join(sentence(15) + passage + sentence(pick.randint(5, 80))))
    order = list(enumerate(texts, 1))
    pick.shuffle(order)
    return order
