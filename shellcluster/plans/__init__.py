"""Estimators, method dispatch and benchmark jobs."""
