"""Query plans: derived fixture frames, the query registry and the engine."""
