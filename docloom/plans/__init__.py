"""Queries by name and their SQL; importing this fills the registry."""

from . import more, node_plans, registry, text_plans  # noqa: F401
