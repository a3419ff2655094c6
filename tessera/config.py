"""Settings of a run as one frozen value on the driver; they are not data."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Every number an analysis depends on (fixed values of the published study are the defaults)."""

    corpus: str = ""
    second_corpus: str = ""
    text_field: str = "text"
    session_field: str = "session"
    min_tokens: int = 4
    mask_classes: tuple[str, ...] = ("PERSON", "TEAM", "PLACE")
    components: int = 5
    smallest: int = 35
    sweep: tuple[int, ...] = (10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 70, 80, 100, 120)
    fdr: float = 0.05
    min_df: int = 3
    max_ngram: int = 2
    max_features: int = 6000
    resamples: int = 200
    resample_share: float = 0.80
    geometry_runs: int = 100
    geometry_rows: int = 15
    factorial_seeds: int = 50
    factorial_sizes: tuple[int, ...] = (30, 35)
    recovery: float = 0.30
    pass_at: float = 0.50
    majority: float = 0.50
    tau: float = 0.40
    taus: tuple[float, ...] = (0.30, 0.35, 0.40, 0.45, 0.50)
    null_runs: int = 1000
    null_seed: int = 4242
    length_runs: int = 10_000
    length_seed: int = 42
    blocks: tuple[int, ...] = (1, 5, 10, 20)
    zero_delta: float = 0.5
    group_count: int = 4
    group_edge: float = 0.50
    keep_classes: bool = True

    def with_(self, **changes) -> Settings:
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"no such settings: {sorted(unknown)}")
        return replace(self, **changes)

    def identity(self) -> dict:
        return asdict(self)


PRESETS = {"single": Settings(min_tokens=4), "paired": Settings(min_tokens=3, second_corpus="required")}


def resolve(preset: str, **changes) -> Settings:
    """A preset with its corpora in place; refuses presets and files that do not exist."""
    if preset not in PRESETS:
        raise ValueError(f"no preset {preset}; there are {sorted(PRESETS)}")
    out = PRESETS[preset].with_(**changes)
    if out.second_corpus == "required":
        raise ValueError("this preset needs second_corpus")
    for path in (out.corpus, out.second_corpus):
        if path and "://" not in path and not Path(path).exists():
            raise ValueError(f"corpus {path} does not exist")
    return out


def describe(s: Settings) -> str:
    """The settings that differ from the defaults, one a line."""
    base = Settings()
    return "\n".join(f"{f.name}: {getattr(s, f.name)!r} (default {getattr(base, f.name)!r})" for f in fields(s) if getattr(s, f.name) != getattr(base, f.name)) or "defaults"


#: A run with fewer clusters or aligned categories, or with less noise, is degenerate.
DEGENERATE_ALIGNED, DEGENERATE_NOISE = 10, 0.05


def sweep_degenerate(n_clusters: int, noise: float, least: int = DEGENERATE_ALIGNED, least_noise: float = DEGENERATE_NOISE) -> bool:
    """Degeneracy of a sweep or seed run: on the raw cluster count."""
    return n_clusters < least or noise < least_noise


def resample_degenerate(n_clusters: int, noise: float, least: int = DEGENERATE_ALIGNED, least_noise: float = DEGENERATE_NOISE) -> bool:
    """Degeneracy of a resampled run: too few raw clusters, or too little left out of them."""
    return n_clusters < least or noise < least_noise


def factorial_degenerate(aligned: int, noise: float, least: int = DEGENERATE_ALIGNED, least_noise: float = DEGENERATE_NOISE) -> bool:
    """Degeneracy of a factorial run: on the number of aligned categories and the training noise."""
    return aligned < least or noise < least_noise
