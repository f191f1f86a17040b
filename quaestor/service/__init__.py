"""Jobs: plug-ins, chains, dead letters, hooks, counters and timed results."""
