"""Query generators and sampling of their executions."""
