"""Tables, constraints and stored intermediates."""
