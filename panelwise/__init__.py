"""panelwise: cohort analytics on Spark DataFrames.

Every public function takes DataFrames (or a SparkSession) and returns a DataFrame, so the steps
chain with ``DataFrame.transform`` and Catalyst sees one plan.
"""

from panelwise.options import Explaining, Thresholds, Training

__all__ = ["Explaining", "Thresholds", "Training"]
