"""The Pfair schedule against the real weights."""

from fractions import Fraction

import pytest

from millrace.llm import mixing


@pytest.mark.parametrize("blocks, weights", [({"a": 62_500, "b": 125_000}, {"a": 1_000_000**0.5, "b": 2_000_000**0.5}), ({"a": 3000, "b": 3100, "c": 3200}, {"a": 1.0, "b": 1.0, "c": 1.0}), ({"a": 50_000, "b": 20}, {"a": 1.0, "b": 0.0004})])
def test_every_source_is_within_a_block_of_its_real_weight(blocks, weights):
    table = mixing.plan_rows(mixing.phases(blocks, weights, 1000), blocks, weights).to_pydict()
    by = dict(zip(table["_slot"], zip(table["_name"], table["_of"], table["_release"], table["_deadline"]), strict=True))
    assert sorted(by) == list(range(sum(blocks.values())))
    total, done = sum(map(Fraction, weights.values())), dict.fromkeys(blocks, 0)
    share = {s: Fraction(w) / total for s, w in weights.items()}
    for t in range(len(by)):
        s, i, release, deadline = by[t]
        assert i == done[s] and release == i // share[s] and deadline == -(-(i + 1) // share[s]) and release <= t < deadline
        done[s] += 1
        if t % 997 == 0:
            assert all(abs(done[x] - (t + 1) * share[x]) < 1 for x in blocks)
        if done[s] == blocks[s]:
            break  # the phase ends
    assert all(abs(done[x] - (t + 1) * share[x]) < 1 for x in blocks)
