"""Where the given tables lie, and an orchard: a small table with a column of every kind."""

import numpy as np
import pandas as pd

TESTDATA = "/root/testdata"
TREES = 720
FIELDS = {"tree": "bigint", "variety": "string", "height": "double", "age": "bigint", "picked": "timestamp", "remark": "string",
          "slope": "string", "buyer": "string", "sweet": "int", "harvest": "double"}


def orchard():
    """harvest grows with height, age and variety, so does the chance of being sweet; buyer is empty, slope is constant."""
    rng = np.random.default_rng(41)
    kind = rng.choice(5, TREES, p=[0.35, 0.25, 0.2, 0.12, 0.08])
    height, age = rng.gamma(4.0, 0.8, TREES), rng.integers(3, 40, TREES)
    vigour = 3 * height + 0.2 * age + 2.5 * kind
    out = pd.DataFrame({"tree": 5000 + 3 * np.arange(TREES)})
    out["variety"] = np.array(["quince", "medlar", "damson", "mirabelle", "bullace"])[kind]
    out["height"], out["age"] = height, age
    out["picked"] = pd.Timestamp("2023-08-14 06:30") + pd.to_timedelta(np.arange(TREES) * 95, unit="min")
    out["remark"] = [f"row {i // 24}, place {i % 24}: pruned in spring, looked over for rust" for i in range(TREES)]
    out["slope"], out["buyer"] = "north", None
    out["sweet"] = (vigour + rng.normal(0, 2.5, TREES) > np.median(vigour)).astype(int)
    out["harvest"] = 4 * vigour + rng.normal(0, 3, TREES)
    return out


def to_spark(spark, pdf):
    rows = [tuple(None if v is None or v != v else v for v in r) for r in pdf.astype(object).itertuples(index=False)]
    rows = [tuple(v.to_pydatetime() if hasattr(v, "to_pydatetime") else v for v in r) for r in rows]
    return spark.createDataFrame(rows, ", ".join(f"{c} {FIELDS[c]}" for c in pdf.columns)).repartition(4).persist()
