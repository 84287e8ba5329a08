"""leadloom: sales-lead cleaning, evidence checking, ranking and publication on Spark."""

__version__ = "0.1.0"
