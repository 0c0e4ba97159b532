import pytest

from bitloom.sources.config import RunConfig


def test_settings():
    c = RunConfig.parse("estimator = huber // robust\n\nfar=2.5\n# note\nskip = 3")
    assert (c.estimator, c.far, c.skip, c.gap) == ("huber", 2.5, 3, 20)
    for bad in ("estimator = none", "relocaliser = 2", "skip = 0", "unknown = 1", "far"):
        with pytest.raises(ValueError):
            RunConfig.parse(bad)
