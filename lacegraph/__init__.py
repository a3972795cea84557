"""Part of lacegraph."""
