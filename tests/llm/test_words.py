import numpy as np
import pytest

from seqloom.llm import words as W


def plain(span):
    total, power = 0, 1
    for byte in span:
        total += (byte + 1) * power
        power = power * W._BASE % (1 << 64)
    return int(W.mix(np.array([total % (1 << 64)], np.uint64))[0])


@pytest.mark.parametrize("stretch", [5, 64, 1 << 18])
def test_hashes_do_not_depend_on_the_stretch(monkeypatch, stretch):
    monkeypatch.setattr(W, "STRETCH_BYTES", stretch)
    monkeypatch.setattr(W, "_POWERS", {})
    data = np.random.default_rng(1).integers(0, 256, 700).astype(np.uint8)
    cuts = np.unique(np.concatenate([[0, 1, 2, 300, 301], np.random.default_rng(2).integers(0, 700, 60), [700]]))
    starts, ends = cuts[:-1], cuts[1:]
    assert W.span_hashes(data, starts, ends).tolist() == [plain(data[a:b].tolist()) for a, b in zip(starts, ends, strict=True)]
    gaps = W.span_hashes(data, starts[::2], ends[::2])
    assert gaps.tolist() == [plain(data[a:b].tolist()) for a, b in zip(starts[::2], ends[::2], strict=True)]


def test_tables_keep_their_size():
    data = np.full(3 << 20, 97, np.uint8)
    W.span_hashes(data, np.array([0]), np.array([len(data)]))
    assert all(len(p) == W.STRETCH_BYTES + 1 for p in W._POWERS.values())
