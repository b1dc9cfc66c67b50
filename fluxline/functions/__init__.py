"""Part of fluxline."""
