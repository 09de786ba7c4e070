"""Column functions and driver-side argument parsing."""
