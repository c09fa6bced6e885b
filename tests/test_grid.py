import pytest

from citesift.registry import modelling


def test_the_registered_searches_take_the_full_grid():
    for grid in (modelling.GRID, modelling.SETTINGS.grid, modelling.FULL.grid):
        steps = [b - a for a, b in zip(grid, grid[1:])]
        assert len(grid) == 200 and steps == pytest.approx([0.99 / 199] * 199)
    assert modelling.FULL.n_topics == 50 and modelling.FULL.passes >= 10
