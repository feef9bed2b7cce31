"""Column functions, and small driver-side helpers for signed checkpoints."""
