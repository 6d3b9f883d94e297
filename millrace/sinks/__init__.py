"""Writers of result text."""
