"""Tests of lacegraph."""
