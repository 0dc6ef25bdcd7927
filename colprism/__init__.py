"""colprism: automated analysis of tables as Spark DataFrame operations."""

from colprism.operators.schema import infer_schema
from colprism.operators.profile import profile
from colprism.plans.task import plan
from colprism.plans.training import train
from colprism.sources.readers import read_any

__all__ = ["infer_schema", "plan", "profile", "read_any", "train"]
