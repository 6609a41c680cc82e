"""Particles stay arrays between rows; a state that came back from a stream as lists goes on alike."""

import numpy as np

from tidemark.operators import stateful


def test_particles_stay_arrays_and_lists_go_on_alike():
    step, rows = stateful.particles(50, 4.0, 25.0, 1000), [(k, 400 * k, 50.0 + 9 * (k % 7)) for k in range(40)]
    state = listed = (None, None, None)
    for row in rows:
        state, out = step(state, row)
        assert isinstance(state[1], np.ndarray) and isinstance(state[2], np.ndarray)
        listed, other = step(tuple(v.tolist() if isinstance(v, np.ndarray) else v for v in listed), row)
        assert out == other
