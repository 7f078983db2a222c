"""The engine's plans and the registered queries."""
