import numpy as np
import pytest

from arkivel.llm import induced_sort
from arkivel.llm.induced_sort import Scratch


def common(t, a, b, most):
    k = 0
    while k < most and a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
        k += 1
    return k


def ascending(t, most, scratch):
    """Positions, and common prefixes with the one before, up to most."""
    pos, lcp = (np.concatenate(x)[::-1] for x in zip(*induced_sort.induced(t, most, scratch), strict=True))
    return pos, np.r_[0, np.minimum(lcp[:-1], most)]


@pytest.mark.parametrize("limit", [40, 64 << 20])  # 40 bytes: queues and arrays go to disk
@pytest.mark.parametrize("few", [0, 2048])  # 0: by doubling if memory suffices
def test_order_and_common_prefixes(tmp_path, monkeypatch, limit, few):
    monkeypatch.setattr(induced_sort, "FEW_NAMES", few)
    rng, most = np.random.default_rng(0), 5
    for trial in range(120):
        t = rng.integers(1, rng.integers(2, 5), rng.integers(1, 60))
        t = np.r_[np.tile(t, 3) if trial % 3 == 0 else t, 0].astype(np.int64)
        order = sorted(range(len(t)), key=lambda i: list(t[i:]))  # noqa: B023
        pos, lcp = ascending(t, most, Scratch(tmp_path, limit))
        assert sorted(pos) == list(range(len(t)))
        assert all(list(t[a : a + most]) == list(t[b : b + most]) for a, b in zip(pos, order, strict=True))
        assert lcp.tolist() == [0, *(common(t, a, b, most) for a, b in zip(order, order[1:], strict=False))]
    assert not list(tmp_path.iterdir())


def test_repeats_among_some_positions(tmp_path, monkeypatch):
    monkeypatch.setattr(induced_sort, "CHUNK", 16)
    rng = np.random.default_rng(4)
    for _ in range(60):
        t = np.r_[np.tile(rng.integers(1, 4, 40), 3)[: rng.integers(50, 110)], rng.integers(1, 3, 30), 0].astype(np.uint16)
        starts = rng.random(len(t)) < 0.3
        (got,) = induced_sort.repeated(t, (6,), Scratch(tmp_path), starts)
        own = [tuple(t[i : i + 6]) for i in np.flatnonzero(starts) if i + 6 <= len(t)]
        assert got.tolist() == [bool(s) and i + 6 <= len(t) and own.count(tuple(t[i : i + 6])) > 1 for i, s in enumerate(starts)]


@pytest.mark.parametrize("limit", [2000, 64 << 20])
def test_many_names(tmp_path, limit):
    """A larger text with long repeats: many names, induced again on disk or doubled in memory, chunk after chunk."""
    rng, most = np.random.default_rng(1), 40
    base = rng.integers(2, 40, 3000)
    t = np.r_[base, base[500:1500], rng.integers(2, 40, 1000), base[800:2600], 1, 1, 0].astype(np.uint16)
    pos, lcp = ascending(t, most, Scratch(tmp_path, limit))
    heads = [t[p : p + most].tolist() for p in pos]
    assert heads == sorted(heads) and sorted(pos) == list(range(len(t)))
    assert all(v == common(t, a, b, most) for v, a, b in zip(lcp[1:], pos, pos[1:], strict=False))


def test_repeats(tmp_path):
    rng = np.random.default_rng(3)
    passage = rng.integers(2, 30, 50)
    t = np.r_[rng.integers(2, 30, 300), passage, 1, rng.integers(2, 30, 200), passage, 0].astype(np.uint16)
    long, short = (np.flatnonzero(x).tolist() for x in induced_sort.repeated(t, (40, 30), Scratch(tmp_path)))
    assert long == [*range(300, 311), *range(551, 562)] and short == [*range(300, 321), *range(551, 572)]
    assert not list(tmp_path.iterdir())
