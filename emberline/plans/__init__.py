"""Ready-made queries over the driver tables, each beside its SQL equivalent."""
