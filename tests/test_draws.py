"""The Monte Carlo's draws, held against the library's md5."""

from hashlib import md5

import numpy as np

from plotline.operators import invest as IV


def test_draws_are_those_of_md5_for_every_length_of_key():
    keys = ["", None, "a", "ab|c", "x" * 31, md5(b"1").hexdigest(), md5(b"2").hexdigest(), "ü" * 20, "y" * 47, "y" * 48, "z" * 200]
    keys += [md5(str(i).encode()).hexdigest() for i in range(100)]
    got = IV._uniforms(keys, 12)
    for row, key in zip(got, keys):
        for i in range(12):
            for j, tag in enumerate(IV._TAGS):
                text = "|".join(p for p in (key, str(i + 1), tag) if p is not None)
                assert row[i, j] == int.from_bytes(md5(text.encode()).digest()[:4]) / 2**32
    assert IV._uniforms([], 3).shape == (0, 3, 3)


def test_a_batch_of_draws_calls_no_hash_a_draw(monkeypatch):
    monkeypatch.setattr(IV, "md5", None)  # a draw of a usual key takes no call of its own
    assert np.all(IV._uniforms([md5(b"1").hexdigest()] * 3, 100) < 1)
