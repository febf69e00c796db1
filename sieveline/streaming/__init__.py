"""Statistics of subgroups over streams."""
