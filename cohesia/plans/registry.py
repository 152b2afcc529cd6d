"""Metrics by name: plans over point frames with their direction, and user metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cohesia.functions.density import cdbw, dbcv
from cohesia.functions.internal import LINEAR
from cohesia.functions.pairwise import PAIRWISE
from cohesia.functions.tree import TREE
from cohesia.operators.edging import ed_calinski_harabasz, ed_davies_bouldin, ed_silhouette
from cohesia.operators.frames import KEYS
from cohesia.operators.grid import sbcvi
from cohesia.session import ship

Plan = Callable[[DataFrame, int], DataFrame]
#: Numbers that a user metric may be given at once (256 MB); more are refused rather than cut.
VALUES = 32 << 20

#: name -> (plan, whether higher is better)
METRICS: dict[str, tuple[Plan, bool]] = {
    **LINEAR, **PAIRWISE, **TREE, "dbcv": (dbcv, True), "cdbw": (cdbw, True), "sbcvi": (sbcvi, True),
    "ed_s": (ed_silhouette, True), "ed_db": (ed_davies_bouldin, False), "ed_ch": (ed_calinski_harabasz, True),
}


def metric(name: str) -> tuple[Plan, bool]:
    """The plan and direction of a metric; raises for unknown names."""
    if name.lower() not in METRICS:
        raise ValueError(f"Unknown metric: {name}")
    return METRICS[name.lower()]


def register(name: str, function: Callable[[np.ndarray, np.ndarray], float], higher: bool = True) -> None:
    """A user metric of (points, labels in order of row_id); it runs for each data set and label set in one task, which holds VALUES numbers at most."""

    def plan(p: DataFrame, dim: int) -> DataFrame:
        ship(p.sparkSession)

        def run(group: pa.Table) -> pa.Table:
            if group.num_rows * dim > VALUES:
                raise ValueError(f"{name} is worked out in one task: {group.num_rows} points of {dim} numbers are over the limit of {VALUES} numbers")
            by = np.argsort(group["row_id"].to_numpy(), kind="stable")
            x = pc.list_flatten(group["x"]).to_numpy().reshape(group.num_rows, -1)
            value = float(function(x[by], group["label"].to_numpy()[by]))
            return pa.table({"dataset": [group["dataset"][0].as_py()], "labelset": [group["labelset"][0].as_py()], "value": [value]})

        return p.select(*KEYS, "row_id", "x", "label").groupBy(*KEYS).applyInArrow(run, "dataset string, labelset string, value double")

    METRICS[name.lower()] = (plan, higher)
