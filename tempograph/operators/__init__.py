"""operators of the temporal knowledge-graph library."""
