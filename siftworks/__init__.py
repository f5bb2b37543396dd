"""Content-safety triage and training-data engine on PySpark."""

from .operators.policy import POLICIES, policy_table
from .operators.udf import DigestScorer, OnnxScorer, Scorer, score_with
from .scanning import scan_folder
from .session import get_spark

__all__ = ["POLICIES", "DigestScorer", "OnnxScorer", "Scorer", "get_spark", "policy_table", "scan_folder", "score_with"]
