"""Settings of a run: read from YAML, checked, written back."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass


@dataclass
class Slicing:
    tile_size: int = 1024
    overlap_ratio: float = 0.2


@dataclass
class Graph:
    snap_radius: float = 15.0
    text_radius: float = 50.0


@dataclass
class Retrieval:
    top_k: int = 5
    #: Optional filters; off as long as they aren't set.
    min_similarity: float | None = None
    use_few_shot: bool = True


@dataclass
class Settings:
    slicing: Slicing = field(default_factory=Slicing)
    graph: Graph = field(default_factory=Graph)
    retrieval: Retrieval = field(default_factory=Retrieval)
    retrain_threshold: int = 50

    @classmethod
    def of(cls, told: dict | None) -> Settings:
        """From nested dicts; what isn't named keeps its default, and unknown names are an error."""
        return _filled(cls(), told or {}, "")

    @classmethod
    def read(cls, text: str) -> Settings:
        import yaml

        return cls.of(yaml.safe_load(text))

    def dump(self) -> str:
        import yaml

        return yaml.safe_dump(asdict(self), sort_keys=False)

    def check(self) -> Settings:
        errors = []
        if self.slicing.tile_size < 256:
            errors.append("tile_size must be 256 at least")
        if not 0 <= self.slicing.overlap_ratio <= 0.5:
            errors.append("overlap_ratio must lie between 0 and 0.5")
        if self.graph.snap_radius < 0:
            errors.append("snap_radius must not be negative")
        if errors:
            raise ValueError("; ".join(errors))
        return self


def _filled(own, told: dict, path: str):
    names = {f.name for f in fields(own)}
    for name, value in told.items():
        if name not in names:
            raise ValueError(f"unknown setting {path}{name}")
        now = getattr(own, name)
        setattr(own, name, _filled(now, value or {}, f"{path}{name}.") if is_dataclass(now) else value)
    return own
