"""Run configuration from key=value text."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class RunConfig:
    """far, gap: distance and frames between key frames. skip: one frame of so many is used. force_every: forced losses."""

    estimator: str = "tukey"
    relocaliser: int = 0
    far: float = 10.0
    gap: int = 20
    skip: int = 1
    force_every: int = 0
    last_frame: int = -1

    def __post_init__(self) -> None:
        if self.estimator not in ("tukey", "cauchy", "huber", "least_squares"):
            raise ValueError(f"no estimator is called {self.estimator}")
        if self.relocaliser not in (0, 1):
            raise ValueError("relocalisers are 0 (sampled) and 1 (refined only)")
        if self.skip < 1 or self.gap < 0 or self.far < 0:
            raise ValueError("skip is 1 or more; gap and far are not negative")

    @classmethod
    def parse(cls, text: str) -> RunConfig:
        """Lines key = value; what follows // or # is a comment. Unknown keys are errors."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found = {}
        for line in text.splitlines():
            line = line.split("//")[0].split("#")[0].strip()
            if line:
                key, sign, value = (x.strip() for x in line.partition("="))
                if not sign or key not in kinds:
                    raise ValueError(f"not a setting: {line}")
                found[key] = kinds[key](value)
        return cls(**found)
