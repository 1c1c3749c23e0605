"""Pagewright: retrieval, lint and evaluation over collections of plain-text pages, Spark first."""
