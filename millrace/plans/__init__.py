"""From a syntax tree to a DataFrame, and to an outline."""
