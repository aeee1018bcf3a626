"""Query catalogue and dashboard rendering."""
