"""End-to-end jobs, session settings, lineage cuts and the registered queries."""
