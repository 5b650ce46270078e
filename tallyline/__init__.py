"""Daily trading reports and data-quality checks as Spark DataFrame jobs."""

from tallyline.spec import ReportSpec

__all__ = ["ReportSpec"]
