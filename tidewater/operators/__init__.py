"""Row, set and ordered-state operators as DataFrame transformations."""
