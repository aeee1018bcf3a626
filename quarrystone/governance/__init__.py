"""Contracts, quality profiles, publication decisions, the stage ledger and its runner."""
