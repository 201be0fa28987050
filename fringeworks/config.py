"""Options of a flagging run."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

QUANTITIES = ("amplitude", "phase", "real", "imag")


# Names and defaults of the options are the public interface.
@dataclass(frozen=True)
class FlagConfig:
    cell_size: float = 10.0
    nsigma: float = 3.0
    smoothing_window: int = 5
    annulus_widths: tuple[float, ...] = (3000.0, 3000.0, 6500.0)
    data_column: str = "auto"
    quantity: str = "amplitude"
    cache_path: str | None = None
    n_workers: int = 0  # kept in the record only: the cluster decides
    min_neighbors: int = 3
    spw_ids: tuple[int, ...] | None = None
    field_ids: tuple[int, ...] | None = None
    uvrange: tuple[float, float] | None = None
    n_bins: int = 256

    def problems(self) -> list[str]:
        """What a run with these options would trip over."""
        wrong = [f"{name} must be positive" for name in ("cell_size", "smoothing_window", "n_bins") if not getattr(self, name) > 0]
        if any(not w > 0 for w in self.annulus_widths):
            wrong.append("annulus_widths must be positive")
        if self.uvrange is not None and not 0 <= self.uvrange[0] <= self.uvrange[1]:
            wrong.append("uvrange must be two ascending numbers")
        return wrong

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> FlagConfig:
        given = json.loads(text)
        known = {f.name: "tuple" in str(f.type) for f in fields(cls)}
        if unknown := sorted(given.keys() - known.keys()):
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        return cls(**{name: tuple(v) if known[name] and v is not None else v for name, v in given.items()})
