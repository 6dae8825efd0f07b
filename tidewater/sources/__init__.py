"""Named tables, JSON Lines sinks and the content-addressed cache."""
