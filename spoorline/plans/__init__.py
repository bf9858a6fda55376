"""Whole-case plans and the queries on the driver's tables."""
