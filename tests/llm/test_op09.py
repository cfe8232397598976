"""Operator 9's tagger where it reads: windows side by side, each to its own end."""

import numpy as np

from matchloom.llm import op09_pii


def test_windows_of_all_widths_get_the_emissions_that_learning_sees():
    r = np.random.default_rng(1)
    tagger, width = op09_pii.Tagger(seed=3), [96, 96, 64, 32]
    ids = np.full((4, 96), 5)
    for k, w in enumerate(width):
        ids[k, :w] = r.integers(0, 31, w)
    together = tagger.emitted(ids, width)
    for k, w in enumerate(width):
        alone = tagger.emissions(ids[k : k + 1, :w])[0][0]
        assert np.abs(together[:w, :, k] - alone).max() < 1e-4


def test_short_and_long_texts_are_read_together(monkeypatch):
    blocks, run = [], op09_pii.Tagger.emitted
    monkeypatch.setattr(op09_pii.Tagger, "emitted", lambda self, ids, width: blocks.append(ids.shape) or run(self, ids, width))
    list(op09_pii.text_emissions(["a" * n for n in (10, 50, 100, 200, 300, 384, 900)], op09_pii.Tagger()))
    assert len(blocks) == 1
