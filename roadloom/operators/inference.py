"""Models over crops: each artifact is loaded once a worker, rows go through it in batches of a class."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from roadloom.catalog import DROPPED_CLASS, LANE_CLASS, RENAMED_CLASSES
from roadloom.params import DEFAULT, Params

#: Fixed value: the coarse class whose fine types may have a model of their own.
TRIANGLE = "treugolnik"


@dataclass(frozen=True)
class Artifact:
    """A model that is loaded where it is first needed: load() gives predict(pictures) -> probabilities, one row each.

    names: what the columns of the probabilities mean.
    """

    key: str
    load: Callable[[], Callable[[list], np.ndarray]]
    names: tuple[str, ...]


_LOADED: dict[str, Callable] = {}


def loaded(artifact: Artifact) -> Callable[[list], np.ndarray]:
    """The artifact's predict function; one load a Python worker."""
    if artifact.key not in _LOADED:
        _LOADED[artifact.key] = artifact.load()
    return _LOADED[artifact.key]


def predicted(artifact: Artifact, pictures: list, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, probabilities) of the likeliest class of each picture, the first of equals."""
    p = np.concatenate([np.asarray(loaded(artifact)(pictures[i : i + batch]), float).reshape(-1, len(artifact.names)) for i in range(0, len(pictures), batch)])
    return np.array(artifact.names, dtype=object)[p.argmax(axis=1)], p.max(axis=1)


@dataclass(frozen=True)
class Cascade:
    """The models of a detection's way: coarse class, fine class by coarse class, second hop by fine class of triangles.

    lane gives (direction, confidence) pairs of the arrows of each picture of a lane sign.
    """

    coarse: Artifact
    fine: Mapping[str, Artifact] = field(default_factory=dict)
    triangles: Mapping[str, Artifact] = field(default_factory=dict)
    lane: Callable[[], Callable[[list], list[list[tuple[str, float]]]]] | None = None


def classify(crops: DataFrame, cascade: Cascade, params: Params = DEFAULT, picture: str = "picture", batch: int = 64) -> DataFrame:
    """crops with name_sign, number_sign and their confidences; rows that a model isn't sure of go.

    The coarse class must reach coarse_confidence; the class that isn't tracked goes and old names become new ones.
    Classes with a model take its likeliest type if that reaches fine_confidence; a triangle whose type has a model of its own
    takes that model's likeliest type, however sure. Lane signs take the types of the arrows that reach lane_confidence,
    others their coarse class. A task holds one Arrow batch; a model gets `batch` pictures of one class at a time.
    Null pictures go; extra columns stay, but the four that are made replace columns of their names.
    """
    from roadloom.catalog import LANE_DIRECTIONS

    made = ["name_sign", "number_sign", "coarse_confidence", "fine_confidence"]
    kept = [f for f in crops.schema.fields if f.name not in made]
    schema = StructType([*kept, *[StructField(c, StringType() if c.endswith("sign") else DoubleType()) for c in made]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf[[f.name for f in kept]]
            pdf = pdf[pdf[picture].notna()].reset_index(drop=True)
            if len(pdf):
                name, sure = predicted(cascade.coarse, pdf[picture].tolist(), batch)
                pdf = pdf.assign(name_sign=pd.Series(name, dtype=object), coarse_confidence=sure)
                pdf = pdf[(pdf.coarse_confidence >= params.coarse_confidence) & (pdf.name_sign != DROPPED_CLASS)].reset_index(drop=True)
                pdf["name_sign"] = pdf.name_sign.map(lambda c: RENAMED_CLASSES.get(c, c)).astype(object)
                pdf["number_sign"], pdf["fine_confidence"] = pdf.name_sign.astype(object), np.nan
                for kind, at in pdf.groupby("name_sign").indices.items():
                    pictures = pdf[picture].iloc[at].tolist()
                    if kind in cascade.fine:
                        fine, sure = predicted(cascade.fine[kind], pictures, batch)
                        fine = np.where(sure >= params.fine_confidence, fine, None)
                        if kind == TRIANGLE:
                            for inner in [x for x in pd.unique(fine) if x in cascade.triangles]:
                                again = np.nonzero(fine == inner)[0]
                                fine[again] = predicted(cascade.triangles[inner], [pictures[i] for i in again], batch)[0]
                        pdf.loc[at, "number_sign"], pdf.loc[at, "fine_confidence"] = np.where(fine == "", kind, fine), sure
                    elif kind == LANE_CLASS and cascade.lane is not None:
                        if "lane" not in _LOADED:
                            _LOADED["lane"] = cascade.lane()
                        arrows = [x for i in range(0, len(pictures), batch) for x in _LOADED["lane"](pictures[i : i + batch])]
                        pdf.loc[at, "number_sign"] = ["-".join(LANE_DIRECTIONS[d] for d, p in a if p >= params.lane_confidence and d in LANE_DIRECTIONS) for a in arrows]
                pdf = pdf[pdf.number_sign.notna()]
                yield pdf[[f.name for f in schema.fields]]

    return crops.mapInPandas(run, schema)
