"""Re-evaluation over a new reading of both sides. There is no stream of events: a refresh is asked for."""
