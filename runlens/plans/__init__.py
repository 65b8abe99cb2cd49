"""Plans of dependent tasks and of review sweeps."""
