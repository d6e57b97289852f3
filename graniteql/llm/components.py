"""Connected components, for the operators here."""

from graniteql.operators.graph import by_other_key, components

__all__ = ["by_other_key", "components"]
