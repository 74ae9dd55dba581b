"""Description of a job: datasets, their splits, and parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from typing import Any

from lumenprep.sources.schema import IMAGE


@dataclass(frozen=True)
class DegradeParams:
    """Parameters of the degradation chain."""

    probability: float = 0.2
    noise_var: float = 0.0005
    blur_margin: float = 1.2
    blur_sigma: float = 0.3
    quality_from: int = 70
    quality_to: int = 95  # exclusive
    noise_channels: str = "all"  # or "first": only the first colour (red)

    def __post_init__(self):
        if self.noise_channels not in ("all", "first"):
            raise ValueError("noise_channels must be 'all' or 'first'")
        if not 1 <= self.quality_from < self.quality_to <= 101:
            raise ValueError("quality bounds must lie in 1..101, the upper one exclusive")

    @property
    def noise_sigma(self) -> int:
        return int(255 * self.noise_var**0.5)


@dataclass(frozen=True)
class DatasetSpec:
    """One dataset: where it is, what to train on, what to hold out.

    ``eval_split`` is None, the name (or slices) of a split, or the fraction of the train
    split to hold out. ``frames`` gives the splits as DataFrames instead of a path.
    """

    name: str
    path: str | None = None
    config: str | None = None
    train_split: str = "train"
    eval_split: float | str | None = None
    degrade_fake: bool = True
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    schema: str | None = None
    id_column: str | None = None
    image_type: str = IMAGE
    frames: dict[str, Any] | None = None

    def __post_init__(self):
        if (self.path is None) == (self.frames is None):
            raise ValueError(f"dataset {self.name}: give either a path or frames")
        check_eval_split(self.eval_split)


def check_eval_split(eval_split: Any, streaming: bool = False) -> None:
    """A held-out part is None, the name of a split or, in batch only, a fraction."""
    if eval_split is None or isinstance(eval_split, str):
        return
    if isinstance(eval_split, bool) or not isinstance(eval_split, float):
        raise ValueError("to hold out rows, name a split or give a fraction")
    if streaming:
        raise ValueError("a fraction cannot be held out of a stream; name a split")
    if not 0.0 < eval_split < 1.0:
        raise ValueError("a fraction to hold out lies between 0 and 1")


@dataclass(frozen=True)
class JobSpec:
    """All datasets of a job and how they are put together."""

    datasets: Sequence[DatasetSpec]
    seed: int
    mix: str = "concat"
    prompt_policy: str = "keep"
    completion_policy: str = "keep"
    shuffle: bool = False
    num_total_samples: int | None = None
    degrade: DegradeParams = DegradeParams()
    degrade_eval: bool = False

    def __post_init__(self):
        if not self.datasets:
            raise ValueError("a job needs at least one dataset")
        if self.mix not in ("concat", "interleave"):
            raise ValueError("mix must be 'concat' or 'interleave'")
        names = [d.name for d in self.datasets]
        if len(set(names)) != len(names):
            raise ValueError("dataset names must differ")

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> JobSpec:
        """Job from parallel lists (or single values, which hold for all datasets).

        Unknown keys and lists of different lengths are errors.
        """
        values = dict(values)
        if isinstance(values.get("degrade"), dict):
            values["degrade"] = DegradeParams(**values["degrade"])
        per_dataset = {
            "dataset_name": "name",
            "dataset_path": "path",
            "dataset_config": "config",
            "train_split": "train_split",
            "eval_split": "eval_split",
            "degrade_fake": "degrade_fake",
            "id_column": "id_column",
            "format": "format",
            "options": "options",
            "schema": "schema",
            "image_type": "image_type",
        }
        known = set(per_dataset) | {f.name for f in fields(cls)} - {"datasets"}
        unknown = sorted(set(values) - known)
        if unknown:
            raise ValueError(f"unknown keys: {unknown}")
        names = values.pop("dataset_name")
        names = [names] if isinstance(names, str) else list(names)
        columns: dict[str, list] = {"name": names}
        for key, attribute in per_dataset.items():
            if key == "dataset_name" or values.get(key) is None:
                values.pop(key, None)
                continue
            given = values.pop(key)
            listed = list(given) if isinstance(given, (list, tuple)) else [given] * len(names)
            if len(listed) != len(names):
                raise ValueError(f"{key} has {len(listed)} entries for {len(names)} datasets")
            columns[attribute] = listed
        columns.setdefault("path", list(names))
        rows = [dict(zip(columns, row)) for row in zip(*columns.values())]
        datasets = [
            DatasetSpec(**{k: v for k, v in r.items() if v is not None or k in ("config", "eval_split")})
            for r in rows
        ]
        return cls(datasets=datasets, **values)
