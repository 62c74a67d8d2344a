"""Tables of the claim graph over time: rules that rows must keep, changes of tables, and committed snapshots."""
