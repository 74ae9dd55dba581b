"""Preparation and evaluation of labelled image, video and chat datasets on Spark."""

from lumenprep.plans.prepare import prepare
from lumenprep.plans.spec import DatasetSpec, DegradeParams, JobSpec

__all__ = ["DatasetSpec", "DegradeParams", "JobSpec", "prepare"]
