"""Layered plans by subject, composed of the operators."""
