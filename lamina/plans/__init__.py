"""Registered queries of the engine's own operators over the driver's tables, each with its SQL where SQL can express it."""
