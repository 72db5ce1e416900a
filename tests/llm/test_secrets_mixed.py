"""The threshold of random-looking strings when unlabelled ids and keys are among the ordinary strings."""

import random
import string

import pytest

from logquarry.llm import secrets

ALPHABETS = (string.ascii_letters + string.digits, "0123456789ABCDEF", string.ascii_lowercase + string.digits)


@pytest.mark.parametrize("count, size", [(0, 8), (50, 8), (200, 16), (1000, 12), (100, 32)])
def test_random_ids_among_ordinary_strings(count, size):
    draw = random.Random(11)
    parts = ["".join(draw.choice(c) for c in ("bcdfglmnprst", "aeiou") * 2) for _ in range(300)] + [
        "the", "request", "value", "index", "count", "server", "config", "handler", "stream", "record"]
    ordinary = list({draw.choice("_-").join(draw.choices(parts, k=draw.randint(1, 3))) for _ in range(6000)})
    ordinary.sort(key=hash_of)
    mixed = ordinary + ["x" + "".join(draw.choices(ALPHABETS[0], k=size - 1)) for _ in range(count)]
    mixed.sort(key=hash_of)
    models = secrets.train(secrets.drawn(8000), mixed)
    for alphabet in ALPHABETS:
        keys = ["".join(draw.choices(alphabet, k=32)) for _ in range(300)]
        assert sum(models.score(k) > models.threshold for k in keys) >= 0.95 * len(keys)
    assert not any(models.score(s) > models.threshold for s in ordinary if len(s) >= 20)


def hash_of(text):
    return secrets.digest(text)
