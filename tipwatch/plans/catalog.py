"""All registered queries; importing the modules fills the registry."""

from tipwatch.plans import audits, bench, files, jobs, logs, reports, streams  # noqa: F401
from tipwatch.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
