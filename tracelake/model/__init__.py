"""Sessions as a small star schema: records, agents, items, calls, compactions, observations, loads, dispatches."""
