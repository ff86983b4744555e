"""Parameters of the layers, as a dataclass and from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from datetime import datetime
from pathlib import Path


@dataclass(frozen=True)
class Params:
    """What the layers need to know; every list is a tuple, every date a naive UTC datetime."""

    projects: tuple[str, ...]
    excluded_types: tuple[str, ...]
    delivered: tuple[str, ...]
    min_created: datetime
    snapshot: datetime
    train_cutoff: datetime
    test_start: datetime
    test_end: datetime
    too_fast_hours: float = 1
    bulk_min: int = 10
    percentile: float = 0.75
    min_group: int = 30
    point_days: int = 7
    peer_window: int = 200
    review_projects: tuple[str, ...] = ()
    #: An open span ends here.
    far_future: datetime = datetime(2100, 1, 1)
    #: Seconds of a time slice; windows over a key are cut into such slices, so a key may hold any share of the rows.
    slice_seconds: int = 90 * 86_400
    factor_min: int = 200

    @classmethod
    def from_toml(cls, path: str | Path, **more: object) -> Params:
        """Every known name found in any section of the file; dates may be strings."""
        values: dict[str, object] = {}
        for section in tomllib.loads(Path(path).read_text()).values():
            values |= section if isinstance(section, dict) else {}
        values |= more
        out = {}
        for f in fields(cls):
            if f.name in values:
                v = values[f.name]
                out[f.name] = tuple(v) if isinstance(v, list) else datetime.fromisoformat(v) if "datetime" in str(f.type) and isinstance(v, str) else v
        return cls(**out)

    def but(self, **changes: object) -> Params:
        return replace(self, **changes)
